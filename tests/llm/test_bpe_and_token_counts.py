from __future__ import annotations

from collections import Counter

import pytest
from heliograph.llm import bpe as B
from heliograph.llm import token_counts as T
from heliograph.llm.common import table

ODD = ["", None, "a" * 20_000, " " * 5000 + "x", "ab" * 700 + " hello", "é" * 300, "\x00\x01 x\n\n  y", "=-" * 200, "don't I'LL 12345678 日本語 🎈", "word " * 50_000]


def test_rank_files_encode_as_the_library_does(spark, sf):
    for path in (B.RANKS, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"):
        enc = T.encoder(path)
        for r in B.encode_decode(table(spark, sf, "documents"), path).collect():
            assert list(r.tokens) == enc.encode_ordinary(r.text) and r.decoded == r.text


@pytest.mark.parametrize("long", [B.LONG, 4])
def test_odd_texts(monkeypatch, long):
    monkeypatch.setattr(B, "LONG", long)
    codec, enc = B.Codec(B.load_ranks(B.RANKS)), T.encoder(B.RANKS)
    texts = [x for x in ODD if long > 4 or x is None or len(x) < 400]
    lists = codec.encode(texts)
    assert lists.to_pylist() == [None if x is None else enc.encode_ordinary(x) for x in texts]
    assert codec.decode(lists).to_pylist() == texts
    assert codec.encode(texts).to_pylist() == lists.to_pylist(), "known pieces"
    codec.forget()
    assert codec.encode(texts).to_pylist() == lists.to_pylist()
    assert codec.encode([]).to_pylist() == []


def test_pairs_of_lower_rank_that_a_merge_makes(tmp_path):
    import base64
    import random

    # "abc" has a lower rank than "ab": contracting a pair can make one that comes before it
    words = [bytes([i]) for i in range(256)] + [b"abc", b"ab", b"bc", b"ca", b"cab", b"aa", b"caa"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(w) + b" %d\n" % i for i, w in enumerate(words)))
    ranks = {w: i for i, w in enumerate(words)}

    def plain(text):
        t = [bytes([x]) for x in text.encode()]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(t, t[1:], strict=False)) if a + b in ranks]
            if not pairs:
                return [ranks[x] for x in t]
            i = min(pairs)[1]
            t[i : i + 2] = [t[i] + t[i + 1]]

    rng = random.Random(0)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (5, 40, 99, 150, 400)]
    assert B.Codec(B.load_ranks(str(path))).encode(texts).to_pylist() == [plain(t) for t in texts]


def test_what_a_task_remembers_is_bounded(monkeypatch):
    codec, enc = B.Codec(B.load_ranks(B.RANKS)), T.encoder(B.RANKS)
    monkeypatch.setattr(B, "REMEMBERED_BYTES", 2000)
    for i in range(30):
        text = " ".join(f"word{i * 7 + k} w" for k in range(10))
        assert codec.encode([text]).to_pylist() == [enc.encode_ordinary(text)]
        assert len(codec.pieces) < 60
    with codec:
        pass
    assert not codec.pieces and not len(codec.tokens)


def test_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5), (None, None, None, None)], "doc_id long, text string, decoded string, tokens int")
    got = B.encode_decode(docs)
    assert got.columns == ["doc_id", "text", "tokens", "decoded"]
    assert B.decode(B.encode(docs)).collect() == got.collect()
    assert got.where("doc_id IS NULL").first().tokens is None
    assert B.encode_decode(docs.limit(0)).count() == 0


def test_histogram_against_lengths(spark, sf):
    docs = table(spark, sf, "documents")
    enc = T.encoder(T.RANKS)
    n = [len(enc.encode_ordinary(r.text)) if r.text else 0 for r in docs.select("text").collect()]
    hist = T.histogram(T.encoded_lengths(docs)).cache()
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == Counter(n)
    for r in T.limits(hist).collect():
        x = r.n_tokens
        assert r.docs_within == sum(k <= x for k in n) and r.docs_over == sum(k > x for k in n)
        assert r.tokens_within == sum(k for k in n if k <= x) and r.tokens_over == sum(k for k in n if k > x)
        assert r.truncated_tokens == sum(min(k, x) for k in n)
        assert abs(r.quantile - sum(k <= x for k in n) / len(n)) < 1e-6
    for limit in (1, 100, 10**6):
        r = T.at_limit(hist, limit).first()
        assert tuple(r) == (len(n), sum(n), sum(k <= limit for k in n), sum(min(k, limit) for k in n), sum(-(-k // limit) for k in n))
    assert T.quantile(hist, 0.5).first().n_tokens == sorted(n)[(len(n) - 1) // 2]


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)] + [(None, "x", 7)], "doc_id long, text string, n_tokens int")
    enc = T.encoder(T.RANKS)
    got = {r.doc_id: r.n_tokens for r in T.encoded_lengths(docs).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(ODD)} | {None: 1}
    twice = T.limits(T.histogram(T.encoded_lengths(docs.unionByName(docs)))).collect()
    once = T.limits(T.histogram(T.encoded_lengths(docs))).collect()
    assert [(r.n_tokens, r.n_docs, r.quantile) for r in twice] == [(r.n_tokens, 2 * r.n_docs, r.quantile) for r in once], "repeated rows count each, ties share a row"
    empty = T.histogram(T.encoded_lengths(docs.limit(0)))
    assert T.limits(empty).count() == 0 and T.quantile(empty, 0.5).count() == 0
    assert tuple(T.at_limit(empty, 10).first()) == (0, 0, 0, 0, 0)
