"""Keys of one and the same series are correlated as one, with the pairs and the order of ties that each of them would have alone."""

from __future__ import annotations

import numpy as np
import pytest
from heliograph.operators import correlation, gathered, graph
from pyspark.sql import functions as F
from test_gathered import rows, small  # noqa: F401
from test_operators import walk


def copies(spark, keys=7, times=5):
    """Series of which the most have copies, some of them many."""
    s = walk(spark, keys, 80)
    s = s.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times))))
    return s.select((F.col("key") + keys * F.col("copy")).alias("key"), "date", "value").where(f"key % {keys} > 1 OR key < {keys}").cache()


def test_the_kernel_meets_a_series_once(spark):
    s = copies(spark)
    asked = lambda x, there, dates, values, edges: (np.ones(len(edges) - 1, np.int64), np.full(len(edges) - 1, len(edges) - 1.0))
    got = correlation.meet(s, None, asked, "others double", block_keys=100).agg(F.count("*"), F.countDistinct("a", "b"), F.max("others")).first()
    n = s.select("key").distinct().count()
    assert tuple(got)[:2] == (n * (n - 1) // 2,) * 2 and got[2] <= 7


@pytest.mark.parametrize("together", [2, 64])
def test_pairs_of_copies(spark, small, monkeypatch, together):  # noqa: F811
    monkeypatch.setattr(correlation, "COPIES", together)
    s = copies(spark)
    p = correlation.pairs_by_join(s).cache()
    assert rows(correlation.correlate(s)) == rows(p)
    odd, even = s.where("key % 2 = 1"), s.where("key % 2 = 0")
    got = {(r.a, r.b): r.corr for r in correlation.correlate(odd, even).collect()}
    want = {(r.a, r.b): r.corr for r in correlation.pairs_by_join(odd, even).collect()}
    assert got.keys() == want.keys() and np.allclose(*([c[k] for k in got] for c in (got, want)))
    best = {r.key: r.best_match for r in gathered.best_match(odd, even).collect()}
    for a, b in best.items():  # the least of the copies of the best
        assert b == min(y for (x, y), c in want.items() if x == a and abs(c) > max(abs(w) for (v, _), w in want.items() if v == a) - 1e-9)
    strong = graph.network(p, 0.2).cache()
    assert rows(gathered.degrees(s, 0.2)) == rows(graph.degrees(strong))
    assert rows(gathered.summary(s)) == rows(correlation.summary(p))


def test_rounding_of_many_is_rounding(spark):
    from heliograph.plans.registry import r6, r6_of_many

    rng, halves = np.random.default_rng(8), (np.arange(-40, 40) + 0.5) / 1e6
    values = [*rng.uniform(-2, 2, 2000), *halves, *np.nextafter(halves, 1), *np.nextafter(halves, -1), -0.0, 1e-7, -4e-7, np.nan, np.inf, -np.inf, 1234567.8912345, 1e300, None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    got = df.select(r6_of_many("v").alias("got"), r6("v").alias("want"))
    assert got.where("NOT got <=> want").isEmpty() and got.where("cast(got AS string) = '-0.0'").isEmpty()


def test_few_edges_are_sorted_for_a_tree_of_copies(spark, monkeypatch):
    held, sorted_, forest = {}, [], gathered.forest
    monkeypatch.setattr(gathered.C, "correlated", lambda left, gather, schema: held.update(gather=gather) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        gathered.minimum_spanning_tree(None, lambda c: c)
    monkeypatch.setattr(gathered, "forest", lambda a, b, w, n: sorted_.append(len(a)) or forest(a, b, w, n))
    rng, n = np.random.default_rng(9), 300
    w = np.round(rng.normal(1.4, 0.1, (n // 6, n // 6)), 9)
    w = np.repeat(np.repeat(np.minimum(w, w.T), 6, 0), 6, 1)
    w[np.arange(n)[:, None] // 6 == np.arange(n) // 6] = 0
    w[7, 8:] = w[:7, 7] = np.nan  # a key without a correlation
    at, tiles = np.arange(n), []
    for hi in range(0, n, 60):
        for lo in range(0, hi + 60, 100):
            x, y = at[lo : min(lo + 100, hi + 60)], at[hi : hi + 60]
            tiles.append((x, y, np.where(x[:, None] < y, 30, 0), [None, w[np.ix_(x, y)]]))
    (got,) = list(held["gather"](at, None, iter(tiles), True))
    a, b = np.triu_indices(n, 1)
    keep = forest(a, b, w[a, b], n)
    assert set(zip(got["a"], got["b"], strict=True)) == set(zip(a[keep], b[keep], strict=True)) and len(keep) == n - 1
    assert sum(sorted_) < 0.6 * n * (n - 1) / 2
