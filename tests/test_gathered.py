"""What blocks gather of their pairs, against the same taken of all pairs as rows."""

from __future__ import annotations

import numpy as np
import pytest
from heliograph.operators import clustering, correlation, filters, gathered, graph
from pyspark.sql import functions as F
from test_operators import walk


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    """Several blocks, tiles and forests of a few keys."""
    monkeypatch.setattr(correlation, "BLOCK_KEYS", 10)
    monkeypatch.setattr(correlation, "LEAST_KEYS", 10)
    monkeypatch.setattr(correlation, "TILE", (4, 3))
    monkeypatch.setattr(gathered, "EDGES", 20)


@pytest.mark.parametrize("whole,sample", [(100, 100), (5, 8)])
def test_gathered_pairs(spark, small, monkeypatch, whole, sample):
    monkeypatch.setattr(gathered, "WHOLE", whole)
    monkeypatch.setattr(gathered, "SAMPLE", sample)
    s = walk(spark, 20, 80)
    s = s.unionByName(s.where("key = 3").select(F.lit(30).cast("long").alias("key"), "date", F.lit(5.0).alias("value"))).cache()  # one that goes with none
    p = correlation.pairs_by_join(s).cache()
    assert rows(gathered.summary(s)) == rows(correlation.summary(p))
    if whole < 10:
        return
    assert rows(gathered.positive_max(s)) == rows(correlation.positive_max(p))
    odd, even = s.where("key % 2 = 1"), s.where("key % 2 = 0")
    assert rows(gathered.best_match(odd, even)) == rows(correlation.best_match(correlation.pairs_by_join(odd, even)))
    strong = graph.network(p, 0.2).cache()
    assert rows(gathered.edges(s, 0.2)) == rows(strong) and rows(gathered.degrees(s, 0.2)) == rows(graph.degrees(strong))
    assert rows(gathered.components(s, 0.2)) == rows(graph.components(strong.select("a", "b")))
    for n in (3, 40):
        assert rows(gathered.head(s, n)) == rows(filters.first_of_matrix(p, n).select("a", "b", "n", "corr"))
    some = s.where("key < 30")
    tree = graph.minimum_spanning_tree(p.where("b < 30").select("a", "b", correlation.distance(F.col("corr")).alias("distance")))
    assert rows(gathered.minimum_spanning_tree(some, lambda c: np.sqrt(2 * (1 - c)))) == rows(tree)
    labels = s.select("key", (F.col("key") % 4).alias("cluster")).distinct().where("key != 7")
    want = clustering.pair_inertia(p.withColumn("distance", correlation.distance(F.col("corr"))), labels)
    assert rows(gathered.pair_inertia(s, labels, lambda c: 2 * (1 - c))) == rows(want)


def test_a_mean_that_is_most_of_the_returns():
    days = np.arange(60)
    grown = 1e7 * (1.01**days - 1)
    x, y = grown + 1e-3 * np.sin(days), grown + 1e-3 * np.sin(days + 1)
    n, corr = correlation.kernel(x, np.ones(60, bool), np.tile(days, 2), np.concatenate([y, grown * 0]), np.array([0, 60, 120]), 20, 1e7)
    r, s = (np.diff(v) / (v[:-1] + 1e7) for v in (x, y))
    assert list(n) == [59, 59] and np.isclose(corr[0], np.corrcoef(r, s)[0, 1], atol=1e-6) and np.isnan(corr[1])


def test_the_forest_is_the_least_with_ties():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 30, (2, 200))
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    w, parent, want = np.round(rng.random(len(a)), 1), list(range(30)), set()

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for _, p, q in sorted(zip(w, a, b, strict=True)):
        if root(p) != root(q):
            parent[root(p)] = root(q)
            want.add((p, q))
    assert {(a[i], b[i]) for i in gathered.forest(a, b, w, 30)} == want
