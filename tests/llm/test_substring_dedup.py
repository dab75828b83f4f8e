from __future__ import annotations

import random
from collections import defaultdict

import pytest
from heliograph.llm import substring_dedup as S
from heliograph.llm.common import table


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "").translate({i: " " for i in range(32)})
    return [w for w in low.split(" ") if w]


def brute(rows, n=S.MIN_WORDS):
    """{(doc_id, kept): (set of words that repeated windows cover, greatest number of copies)} of distinct rows."""
    rows = sorted({(2**63 if i is None else i, t) for i, t in rows if t is not None}, key=lambda r: r[0])
    where = defaultdict(list)
    for at, (_, t) in enumerate(rows):
        w = words_of(t)
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].append((at, i))
    out = defaultdict(lambda: [set(), 0])
    for places in where.values():
        if len(places) > 1:
            for k, (at, i) in enumerate(places):
                x = out[rows[at][0], k == 0]
                x[0].update(range(i, i + n))
                x[1] = max(x[1], len(places))
    return {k: (frozenset(v[0]), v[1]) for k, v in out.items()}


def found(docs):
    out = defaultdict(lambda: [set(), 0])
    for r in S.repeated_passages(docs).collect():
        x = out[2**63 if r.doc_id is None else r.doc_id, r.kept]
        x[0].update(range(r.start_word, r.end_word))
        x[1] = max(x[1], r.copies)
    return {k: (frozenset(v[0]), v[1]) for k, v in out.items()}


def test_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(want) > 50
    assert found(docs) == want


def test_small_packs_and_full_bitmap_give_the_same(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    want = found(docs)
    monkeypatch.setattr(S, "PACK", 50)
    monkeypatch.setattr(S, "BITMAP_BITS", 1 << S._ROW_BITS)
    assert found(docs) == want


@pytest.mark.parametrize("pack", [1, 3, 10, 40])
def test_longer_prefixes_give_the_same(spark, monkeypatch, pack):
    rng = random.Random(pack)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    head, tail, hot = word(70), word(70), word(120)
    rows = []
    for i in range(60):  # passages that part, to the left and to the right of what they share
        rows.append((i, " ".join(word(5) + head[rng.randrange(40) :] + hot[: rng.randrange(20, 121)] + tail[: rng.randrange(70)] + word(5))))
    rows += [(100 + i % 7, " ".join(hot)) for i in range(30)] + [(None, " ".join(hot)), (0, rows[0][1]), (200, " ".join(word(3) * 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "PACK", pack)
    prefixes, whole = S._prefixes(docs)
    assert len(prefixes.crowded) > len(whole) >= (pack < 40) and found(docs) == brute(rows)


def test_crowded_prefixes_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(200))) for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(S, "PACK", 2)
    want = found(docs)
    for longer in (0, 5):
        monkeypatch.setattr(S, "LONGER", longer)
        assert len(S._prefixes(docs)[0].crowded) <= 2 * longer and found(docs) == want


def test_nothing_repeats_after_deduplication(spark, sf):
    docs = table(spark, sf, "documents")
    left = S.deduplicate(docs)
    assert left.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    cut = brute([(r.doc_id, r.text) for r in docs.collect()])
    for r in left.collect():
        gone = cut.get((r.doc_id, False), (frozenset(), 0))[0]
        w = words_of(before[r.doc_id])
        assert words_of(r.text) == [x for i, x in enumerate(w) if i not in gone]
        assert r.n_chars == len(r.text) or not gone


def test_edge_cases(spark):
    p = " ".join(f"p{i}" for i in range(60))
    q = " ".join(f"q{i}" for i in range(49))
    rows = [
        (1, f"start {p} end", "x"),
        (2, f"other {p.upper()}\n\ttail", None),
        (2, f"other {p.upper()}\n\ttail", None),  # a repeated row
        (3, q, "y"),
        (4, q, "y"),  # one word short of a repeat
        (5, None, "z"),
        (6, "", "z"),
        (7, p, "all of it goes"),
        (None, f"{p} last", "no id"),
        (8, " ".join([p] * 3), "repeats itself"),
        (9, " ".join(f"l{i}" for i in range(100_000)), "long"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("*", "key AS _x", "key AS g", "key AS kept")
    assert found(docs) == brute([(r[0], r[1]) for r in rows])
    left = S.deduplicate(docs)
    assert left.columns == docs.columns
    texts = sorted((str(r.doc_id), r.text) for r in left.collect() if r.doc_id != 9)
    assert texts == sorted([("1", rows[0][1]), ("2", "other tail"), ("2", "other tail"), ("3", q), ("4", q), ("5", None), ("6", ""), ("None", "last")], key=lambda x: (x[0], x[1] or ""))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeated_passages(docs).count() == 0 and S.deduplicate(docs).count() == 0
