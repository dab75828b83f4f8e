from __future__ import annotations

import math
from collections import Counter

import numpy as np
from heliograph.llm import language_id as L
from heliograph.llm.common import table
from heliograph.llm.textnum import chunks

import pyarrow as pa


def ngrams(text: str) -> list[str]:
    """The n-grams that the vectorised code counts, character by character."""
    fold = [chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text]
    letter = lambda c: "a" <= c <= "z" or ord(c) >= 0xAA and c not in "×÷"
    s = [c if letter(c) else " " for c in fold]
    s = [c for i, c in enumerate(s) if letter(c) or i == 0 or letter(s[i - 1])]
    return ["".join(s[i : i + k]) for k in L.ORDERS for i in range(len(s) - k + 1) if any(map(letter, s[i : i + k]))]


def test_ngrams_against_plain_python():
    texts = ["Hello, World 12!", "", "ÀÉÎ x÷y", "  a  b ", "日本 語", "123 !!"]
    for _, _, data, offs in chunks(pa.array(texts)):
        buckets, docs = L.ngram_buckets(data, offs)
    assert [Counter(docs.tolist())[i] for i in range(len(texts))] == [len(ngrams(t)) for t in texts]
    words = {}
    for t, i in zip(texts, range(len(texts)), strict=True):
        own = buckets[docs == i].tolist()
        for g, b in zip(ngrams(t), own, strict=True):
            assert words.setdefault(g, b) == b, "an n-gram has one bucket"


def test_long_texts_in_blocks(monkeypatch):
    texts = pa.array(["the cat, sat " * 50, "", "à bientôt", "x"])
    (_, _, data, offs), = chunks(texts)
    whole = sorted(zip(*(x.tolist() for x in L.ngram_buckets(data, offs)), strict=True))
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(L, "BLOCK", size)
        assert sorted(zip(*(x.tolist() for x in L.ngram_buckets(data, offs)), strict=True)) == whole


def test_word_hashes_in_chunks(monkeypatch):
    from heliograph.llm import textnum as N

    texts = pa.array(["the Cat sat", None, "x" * 300 + " y " + "zz" * 70, " a  b "])
    (_, _, data, offs), = chunks(texts)
    whole = N.hashed_words(data, offs)[0]
    monkeypatch.setattr(N, "_pow", [])
    monkeypatch.setattr(N, "CHUNK_BYTES", 16)
    assert (N.hashed_words(data, offs)[0] == whole).all() and len(set(whole.tolist())) == 8


def test_rows_without_an_id_are_sampled_like_others(spark):
    docs = spark.createDataFrame([(None, f"some words number {i}", "en") for i in range(2000)] + [(1, None, "en"), (2, " ", "en")], "doc_id long, text string, lang string")
    all_, some = L.train(docs, per_language=10**6), L.train(docs, per_language=100)
    # as many distinct rows, as much mass above the smoothing
    mass = lambda m: 1 / np.exp(m.log_prob).min() * L.ALPHA - L.ALPHA * L.BUCKETS
    assert 0.02 < mass(some) / mass(all_) < 0.1
    assert some.prior.tolist() == [0.0]


def test_posterior_against_plain_python(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "the dog and the bone", "en"), (4, "la vache et le chien", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs, per_language=10**6)
    counts = {x: Counter(g for _, t, lang in rows if lang == x for g in ngrams(t)) for x in ("en", "fr")}
    text = "the chat on the table"
    ll = []
    for x in ("en", "fr"):
        n = sum(counts[x].values())
        ll.append(sum(math.log(counts[x][g] + L.ALPHA) - math.log(n + L.ALPHA * L.BUCKETS) for g in ngrams(text)) + math.log(0.5))
    got = L.identify(spark.createDataFrame([(9, text)], "doc_id long, text string"), model).first()
    want = 1 / (1 + math.exp(-abs(ll[0] - ll[1])))
    assert got.lang == ("en" if ll[0] > ll[1] else "fr") and abs(got.posterior - want) < 1e-4  # buckets may be shared


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) >= 200")
    got = {r.doc_id: r for r in L.identify(docs.where("doc_id % 4 = 0"), L.train(docs.where("doc_id % 4 != 0"))).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("doc_id % 4 = 0").collect()}
    known = [i for i in truth if got[i].lang != "und"]
    assert np.mean([got[i].lang == truth[i] for i in known]) > 0.95
    assert len(known) > 0.8 * len(truth)


def test_edge_cases(spark, sf):
    docs = table(spark, sf, "documents")
    model = L.train(docs)
    some = docs.where("length(text) > 300").first()
    rows = [(1, None, "en"), (2, "", "en"), (3, "12345 !!!", None), (4, some.text, some.lang), (4, some.text, some.lang), (None, some.text, None), (5, some.text * 300, some.lang), (6, some.text, "xx")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang AS posterior")
    got = L.identify(odd, model).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.lang for r in got if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert all(r.lang == some.lang for r in got if r.doc_id in (None, 4, 5, 6))
    kept = L.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "5", "6", "None"]


def test_empty_and_unlabelled_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.train(empty)
    assert L.identify(empty, model).count() == 0 and L.keep_identified(empty, model).count() == 0
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang for r in L.identify(rows, L.train(rows)).collect()] == ["und"]
