from __future__ import annotations

from collections import defaultdict

import pytest
from heliograph.llm import near_dedup as N
from heliograph.llm.common import table


def shingles(text: str | None, k: int = N.SHINGLE) -> frozenset:
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate({i: " " for i in range(32)}).split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def similar_pairs(rows, least):
    sets = [(i, s) for i, t in rows if (s := shingles(t)) and i is not None]
    where = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(n)
    common = defaultdict(int)
    for at in where.values():
        if len(at) < 400:
            for p in range(len(at)):
                for q in range(p):
                    common[at[q], at[p]] += 1
    out = {}
    for (p, q), n in common.items():
        j = n / (len(sets[p][1]) + len(sets[q][1]) - n)
        if j >= least:
            out[tuple(sorted((sets[p][0], sets[q][0])))] = j
    return out


def groups(found):
    root = {}
    for r in found:
        root[r.doc_id] = r.kept_id
    return lambda x: root.get(x, x)


def test_recall_and_precision_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    of = groups(N.near_duplicates(docs).collect())
    true = {p for p in similar_pairs(rows, N.THRESHOLD) if p[0] != p[1]}
    assert len(true) > 50
    assert sum(of(a) == of(b) for a, b in true) >= 0.9 * len(true)
    near = similar_pairs(rows, N.THRESHOLD - 0.15)
    partners = defaultdict(set)
    for a, b in near:
        partners[a].add(b)
        partners[b].add(a)
    gone = [i for i, _ in rows if of(i) != i]
    assert all(any(of(x) == of(i) for x in partners[i]) for i in gone), "a document in a group is like another one of it"


def test_one_of_each_group_stays(spark, sf):
    docs = table(spark, sf, "documents")
    found = N.near_duplicates(docs).collect()
    kept = {r.doc_id for r in N.deduplicate(docs).select("doc_id").collect()}
    everything = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept == everything - {r.doc_id for r in found if r.doc_id != r.kept_id}
    assert {r.kept_id for r in found} <= kept


def test_nulls_repeats_ties_long_texts_and_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(1, words, "a"), (2, words.upper().replace(" ", "\n"), "b"), (2, words.upper().replace(" ", "\n"), "b"), (3, None, None), (None, words, "c"), (4, "", "d"), (5, "   ", "e"), (6, "short", "f"), (7, "short", "g"), (8, long, "h"), (9, long + " tail", None), (10, "alone here", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string").selectExpr("*", "sig AS kept_id", "sig AS region", "sig AS ids", "sig AS root")
    got = {(r.doc_id, r.kept_id, r.group_size) for r in N.near_duplicates(docs).collect()}
    assert got == {(2, 1, 3), (None, 1, 3), (7, 6, 2), (9, 8, 2)}
    left = N.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted([(False, i) for i in (1, 3, 4, 5, 6, 8, 10)])


def test_repeated_rows_alone(spark):
    docs = spark.createDataFrame([(1, "one two three four")] * 3, "doc_id long, text string")
    assert [tuple(r) for r in N.near_duplicates(docs).collect()] == [(1, 1, 1)]
    assert N.deduplicate(docs).count() == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert N.near_duplicates(docs).count() == 0
    assert N.deduplicate(docs).count() == 0


def test_ids_that_repeat_with_other_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (5, a), (6, b), (7, c)], "doc_id long, text string")
    assert sorted(tuple(r) for r in N.near_duplicates(docs).collect()) == [(5, 1, 2), (6, 1, 2)]
    assert sorted((r.doc_id, r.text) for r in N.deduplicate(docs).collect()) == [(1, a), (1, b), (7, c)]


def all_pairs(nodes, sig, end):
    """Edges of regions by comparing all their rows."""
    import numpy as np

    equal = (sig[:, None] == sig[None]).sum(2) >= N._LEAST_EQUAL
    x, y = np.nonzero(equal & (end[:, None] == end[None]))
    low = np.arange(len(nodes))
    for _ in nodes:
        for i, j in zip(x, y, strict=True):
            low[i] = low[j] = min(low[i], low[j], key=lambda k: nodes[k])
        if (low == low[low]).all() and all(low[i] == low[j] for i, j in zip(x, y, strict=True)):
            break
    return {(nodes[i], nodes[low[i]]) for i in range(len(nodes)) if low[i] != i}


def crowd(n, seed=1):
    """n signatures of one region in a tree's order; each second one is like the one before, some are like many."""
    import numpy as np

    rng = np.random.default_rng(seed)
    width = N.TREES * N.DEPTH
    sig = rng.integers(0, 256, (n, width), dtype=np.uint8)
    for i in range(1, n, 2):  # pairs of a Jaccard similarity of about 0.5 to 0.7
        same = rng.random(width) < rng.uniform(0.5, 0.7)
        sig[i, same] = sig[i - 1, same]
    sig[::7, 40:] = sig[0, 40:]
    sig[:, : N.LEAST_DEPTH] = 7
    order = np.lexsort(sig[:, : N.DEPTH].T[::-1])
    return rng.permutation(n)[order], sig[order]


@pytest.mark.parametrize("near", [1, 5, 24])
def test_no_pair_of_a_crowded_region_is_lost(monkeypatch, near):
    import numpy as np

    nodes, sig = crowd(300)
    end = np.repeat([120, 150, 300], [120, 30, 150])
    want = all_pairs(nodes, sig, end)
    assert len(want) > 80
    monkeypatch.setattr(N, "NEAR", near)
    for passes in (1, 64, 1 << 22):
        monkeypatch.setattr(N, "PASS_PAIRS", passes * 300)
        assert set(zip(*N.region_edges(nodes, sig, end), strict=True)) == want


def test_a_link_through_a_row_that_is_close_to_an_earlier_head_counts(monkeypatch):
    import numpy as np

    a = np.zeros(N.TREES * N.DEPTH, np.uint8)
    x, y = a.copy(), a.copy()
    x[80:] = 1  # close to both of the others, which aren't close
    y[40:] = 1
    for near in (1, 3):
        monkeypatch.setattr(N, "NEAR", near)
        for order in ([0, 1, 2, 3], [0, 3, 2, 1], [2, 0, 3, 1]):
            got = N.region_edges(np.arange(4)[order], np.stack([a, x, y, a + 9])[order], np.full(4, 4))
            assert list(zip(*got, strict=True)) == [(1, 0), (2, 0)]


def test_crowded_regions_in_blocks(spark, monkeypatch):
    _, sig = crowd(200)
    nodes = spark.createDataFrame([(i, bytes(x)) for i, x in enumerate(sig)], "node long, sig binary").cache()
    whole = {tuple(r) for r in N.components(N.forest_edges(nodes)).collect()}
    assert len(whole) > 50
    monkeypatch.setattr(N, "CROWD", 30)
    assert nodes.count() * N.TREES // N.CROWDED < 30
    assert {tuple(r) for r in N.components(N.forest_edges(nodes)).collect()} == whole


def test_one_of_the_copies_without_an_id_stays(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one two three four"), *[(None, words)] * 3, (None, words + " more"), (None, "apart from the others"), (None, None), (None, None), (None, " ")]
    left = N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [r.text for r in left if r.doc_id is None]
    assert len(left) == 6 and len(texts) == 5 and [r.doc_id for r in left if r.doc_id] == [1]
    assert len([t for t in texts if t and t.startswith(words)]) == 1
    assert texts.count(None) == 2 and " " in texts and "apart from the others" in texts
