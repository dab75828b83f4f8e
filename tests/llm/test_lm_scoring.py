from __future__ import annotations

import numpy as np
from heliograph.llm import lm_scoring as M
from heliograph.llm.common import table
from heliograph.llm.textnum import chunks

import pyarrow as pa


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    share = rng.random(M.CLASSES)
    share[0] = 0
    share /= share.sum()
    t = M.Trainer(M.Model.start(share), share, 0)
    t.m.Q *= 8
    t.m.R *= 8
    w, w1, w2 = (rng.integers(1, 40, 200) for _ in range(3))
    noise = np.array([3, 3, 5, 41, 50])

    def objective(m):
        m = [x.astype(float) for x in (m.Q, m.R, m.b, m.C)]
        q, r, b, c = m
        p = q[w1] @ c[0] + q[w2] @ c[1]
        log_sigmoid = lambda x: -np.logaddexp(0, -x)
        off = np.log(np.maximum(share, 1e-12) * M.NOISE)
        return log_sigmoid((p * r[w]).sum(1) + b[w] - off[w]).sum() + log_sigmoid(-(p @ r[noise].T + b[noise] - off[noise])).sum()

    rows_q, rows_r, gc = t.gradients(w, w1, w2, noise)
    assert set(rows_q) == {*w1, *w2} and set(rows_r) == {*w, *noise}
    untouched = np.setdiff1d(np.arange(M.CLASSES), rows_q)
    assert not t.grad[0][untouched].any()
    for x, g, at in ((t.m.Q, t.grad[0], (w1[0], 4)), (t.m.Q, t.grad[0], (w2[1], 0)), (t.m.R, t.grad[1], (3, 7)), (t.m.R, t.grad[1], (41, 2)), (t.m.R, t.grad[1], (w[5], 1)), (t.m.b, t.grad[2], (3,)), (t.m.b, t.grad[2], (w[0],)), (t.m.C, gc, (0, 3, 4)), (t.m.C, gc, (1, 2, 2))):
        kept, up = x[at], np.float32(1e-2)
        x[at] = kept + up
        high = objective(t.m)
        x[at] = kept - up
        low = objective(t.m)
        x[at] = kept
        assert abs((high - low) / (2 * up) - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_steps_are_of_adagrad():
    share = np.full(M.CLASSES, 1 / M.CLASSES)
    a, b = (M.Trainer(M.Model.start(share), share, 7) for _ in range(2))
    w = np.array([5, 6, 5, 7])
    a.batch(w, w[::-1].copy(), np.zeros(4, np.int64))
    noise = np.minimum(np.searchsorted(b.cumulative, b.rng.random(M.NOISE)), M.CLASSES - 1)
    rows_q, _, g = b.gradients(w, w[::-1].copy(), np.zeros(4, np.int64), noise)
    want = b.m.Q + M.RATE * b.grad[0] / np.sqrt(1e-2 + b.grad[0] ** 2)
    assert np.allclose(a.m.Q, want, atol=1e-6) and np.allclose(a.m.C, b.m.C + M.RATE * g / np.sqrt(1e-2 + g * g), atol=1e-6)
    assert not a.grad[0].any() and a.seen == 4


def test_counts_in_a_task_are_merged(monkeypatch):
    monkeypatch.setattr(M, "HELD", 50)
    rng = np.random.default_rng(0)
    words, total = rng.integers(0, 200, (40, 30)).astype(np.uint64), np.zeros(200, int)
    counter, out = M._Counter(), []
    for x in words:
        if (full := counter.add(x)) is not None:
            out.append(full)
    if counter.parts:
        counter.merge()
        out.append(counter.batch())
    for batch in out:
        np.add.at(total, batch.column(0).to_numpy(), batch.column(1).to_numpy())
    assert len(out) > 1 and (total == np.bincount(words.ravel().astype(int), minlength=200)).all()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = M.Model.start(np.full(M.CLASSES, 1 / M.CLASSES))
    model.Q[:] = rng.normal(size=model.Q.shape)
    s = M.Scorer(model)
    every = np.arange(1, M.CLASSES)
    for w1, w2 in ((0, 0), (5, 0), (17, 2000)):
        p = np.exp(s.log_probs(every, np.full(len(every), w1), np.full(len(every), w2)).astype(float))
        assert abs(p.sum() - 1) < 1e-4
        q = model.Q[w1] @ model.C[0] + model.Q[w2] @ model.C[1]
        logits = (q @ model.R.T + model.b)[1:].astype(float)
        want = np.exp(logits - logits.max())
        assert np.allclose(p, want / want.sum(), atol=1e-5)


def test_counts_cover_the_corpus_and_training_beats_the_unigram(spark, sf):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    vocab = M.vocabulary(docs)
    assert abs(vocab.share.sum() - 1) < 1e-9
    model = M.train(M.encode(docs.where("doc_id % 5 != 0"), vocab), vocab)
    held = M.encode(docs.where("doc_id % 5 = 0"), vocab)

    def mean(m):
        r = M.score(held, vocab, m).selectExpr("sum(log_prob) AS s", "sum(n_tokens) AS n").first()
        return r.s / r.n

    unigram = M.Model.start(vocab.share)
    unigram.Q[:] = 0
    assert mean(model) > mean(unigram) + 0.1


def test_scores_against_a_plain_loop(spark):
    texts = ["The cat sat.", "the CAT", "", None, "   ", "one " * 3000, "x"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "the cat", 0.5), (0, texts[0], 0.5)], "doc_id long, text string, log_prob double")
    vocab = M.vocabulary(docs)
    model = M.train(M.encode(docs, vocab), vocab)
    scorer = M.Scorer(model)
    got = M.score(M.encode(docs, vocab), vocab, model, tokens=True).collect()
    assert len(got) == docs.count()
    for r, text in zip(sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id), [texts[0], *texts], strict=True):
        if not (text or "").split():
            assert (r.n_tokens, r.log_prob, r.mean_log_prob) == (0, 0.0, None)
            continue
        for _, _, data, offs in chunks(pa.array([text])):
            w, w1, w2, _ = M.contexts(vocab, data, offs)
        assert list(w1) == [0, *w[:-1]] and list(w2) == [0, 0, *w[:-2]][: len(w)]
        want = [float(scorer.log_probs(w[i : i + 1], w1[i : i + 1], w2[i : i + 1])[0]) for i in range(len(w))]
        assert r.n_tokens == len(text.split()) and abs(r.log_prob - sum(want)) < 1e-3
        assert np.allclose(r.token_log_probs, want, atol=1e-5)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vocab = M.vocabulary(docs)
    assert M.score(M.encode(docs, vocab), vocab, M.train(M.encode(docs, vocab), vocab)).count() == 0


def test_words_of_a_class_have_their_own_probabilities_that_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP_TOKENS", 1000)
    names = [f"w{i}" for i in range(3000)]
    text = " ".join(" ".join([w] * (1 + i % 7)) for i, w in enumerate(names))
    corpus = spark.createDataFrame([(0, text), (1, text)], "doc_id long, text string")
    vocab = M.vocabulary(corpus)
    model = M.Model.start(vocab.share)
    alone = spark.createDataFrame([*enumerate(names), (3000, "unseen")], "doc_id long, text string")
    got = {r.doc_id: r for r in M.score(M.encode(alone, vocab), vocab, model, tokens=True).collect()}
    assert len(got) == 3001 and all(abs(r.log_prob - r.token_log_probs[0]) < 1e-4 for r in got.values())
    zero = np.zeros(M.SHARED, np.int64)
    of_class = np.exp(M.Scorer(model).log_probs(zero + np.arange(M.CLASSES - M.SHARED, M.CLASSES), zero, zero).astype(float))
    unseen = of_class / (vocab.shared + 1)
    assert abs(sum(np.exp(got[i].log_prob) for i in range(3000)) + unseen.sum() - 1) < 1e-4
    (_, _, data, offs), = chunks(pa.array(["unseen"]))
    c = M.contexts(vocab, data, offs)[0][0] - (M.CLASSES - M.SHARED)
    assert abs(got[3000].log_prob - np.log(unseen[c])) < 1e-5
    # a whole text is the sum of its words, however its words are grouped
    (whole,) = M.score(M.encode(corpus.where("doc_id = 0"), vocab), vocab, model, tokens=True).collect()
    (plain,) = M.score(M.encode(corpus.where("doc_id = 0"), vocab), vocab, model).collect()
    assert whole.n_tokens == len(whole.token_log_probs) == len(text.split())
    assert abs(plain.log_prob - np.sum(whole.token_log_probs, dtype=float)) < 0.1
