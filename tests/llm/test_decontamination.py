from __future__ import annotations

from heliograph.llm import decontamination as D
from heliograph.llm.common import table
from test_substring_dedup import words_of


def brute(docs, items, least=D.MIN_WORDS):
    out = set()
    for item, text in {(i, t) for i, t in items if t is not None}:
        b = words_of(text)
        if not b:
            continue
        need, starts = min(least, len(b)), {}
        for j in range(len(b) - need + 1):
            starts.setdefault(tuple(b[j : j + need]), []).append(j)
        for doc, text in docs:
            a, best = words_of(text), None
            if len(b) < D.LEAST_ITEM_WORDS and a != b:
                continue
            for i in range(len(a) - need + 1):
                for j in starts.get(tuple(a[i : i + need]), ()):
                    n = need
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if best is None or (-n, i, j) < best:
                        best = (-n, i, j)
            if best:
                out.add((doc, -1 if item is None else item, -best[0], best[1], best[2]))
    return out


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert len(want) > 10
    assert {tuple(r) for r in D.find_matches(docs, bench).collect()} == want
    left = {r.doc_id for r in D.decontaminate(docs, bench).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.collect()} - {w[0] for w in want}


def test_benchmark_in_several_slices(spark, sf, monkeypatch):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = {tuple(r) for r in D.find_matches(docs, bench).collect()}
    kept = D.decontaminate(docs, bench).count()
    monkeypatch.setattr(D, "SLICE_BYTES", 2000)
    assert {tuple(r) for r in D.find_matches(docs, bench).collect()} == want
    assert D.decontaminate(docs, bench).count() == kept


def test_edge_cases(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"x {item} y {item}", "a"), (1, f"x {item} y {item}", "a"), (2, item.upper().replace(" ", "\t\n"), None), (3, None, "b"), (4, "", "c"), (5, "one two three four five six seven", "d"), (None, item, "e"), (6, "a b c d e", "f"), (7, ("z " * 50_000) + item, "g"), (8, "a b c d", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").selectExpr("*", "item_id AS match_words")
    items = [(1, item), (1, item), (None, "a b c d e"), (2, "a b c d"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text AS doc_id")
    got = sorted(map(tuple, D.find_matches(docs, bench).collect()), key=str)
    want = brute([(r[0], r[1]) for r in rows], items)
    assert set(got) == want and len(got) == len(want) + 1  # the repeated row
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5]


def test_empty_tables(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    assert D.find_matches(docs.limit(0), bench).count() == 0
    assert D.find_matches(docs, bench.limit(0)).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == docs.count()
