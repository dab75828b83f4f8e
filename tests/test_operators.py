"""Small fixtures and properties of the operators."""

from __future__ import annotations

import numpy as np
import pytest
from heliograph.functions import dense
from heliograph.operators import clustering, correlation, features, graph, series, store, validation
from heliograph.sources import tables
from pyspark.sql import functions as F


def walk(spark, keys, days, seed=0, step=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        total = 0.0
        for i in range(0, days, step):
            total += float(rng.normal(0, 1e5))
            if rng.random() < 0.9:
                rows.append((k, f"{2020 + i // 336}-{i // 28 % 12 + 1:02d}-{i % 28 + 1:02d}", total))
    return spark.createDataFrame(rows, "key long, date string, value double").withColumn("date", F.to_date("date"))


def pairs(df):
    return {(r.a, r.b): (r.n, None if r.corr is None else round(r.corr, 9)) for r in df.collect()}


def test_blocks_give_what_the_join_gives(spark):
    s = walk(spark, 9, 120)
    want = pairs(correlation.pairs_by_join(s))
    assert len(want) == 36 and all(-1 <= c <= 1 for _, c in want.values())
    for keys in (2, 4, 100):
        assert pairs(correlation.pairs_by_block(s, block_keys=keys)) == want
    left, right = s.where("key < 4"), s.where("key >= 4")
    assert pairs(correlation.pairs_by_block(left, right, block_keys=3)) == pairs(correlation.pairs_by_join(left, right))


@pytest.mark.parametrize("days,want", [(19, {}), (20, {}), (21, {(1, 2): (20, 1.0)})])
def test_gates_of_the_kernel(spark, days, want):
    rows = [(k, i, float((i * 37) % 11) * 1e5) for k in (1, 2) for i in range(days)]
    s = spark.createDataFrame(rows, "key long, i int, value double").select("key", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("date"), "value")
    assert pairs(correlation.pairs_by_block(s)) == pairs(correlation.pairs_by_join(s)) == want


def test_constant_series_have_no_correlation(spark):
    rows = [(k, i, 5.0 if k == 1 else float((i * 37) % 11)) for k in (1, 2) for i in range(40)]
    s = spark.createDataFrame(rows, "key long, i int, value double").select("key", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("date"), "value")
    assert pairs(correlation.pairs_by_block(s)) == {(1, 2): (39, None)}
    assert correlation.summary(correlation.correlate(s)).count() == 0


def test_summary_order_and_shrinkage(spark):
    p = correlation.correlate(walk(spark, 6, 100))
    for r in correlation.summary(p).collect():
        assert r.min_correlation <= r.median_correlation <= r.max_correlation
    t = spark.createDataFrame([(0.1,)], "threshold double")
    assert correlation.thresholded(p, t).where("corr <> 0").count() <= p.where("corr <> 0").count()


def test_trees_and_components(spark):
    edges = [(a, b, ((a * 7919 + b * 104729) % 1000) / 10) for a in range(12) for b in range(a + 1, 12)] + [(20, 21, 1.0), (21, 22, 1.0), (20, 22, 1.0)]
    df = spark.createDataFrame(edges, "a long, b long, distance double")
    tree = [(r.a, r.b, r.distance) for r in graph.minimum_spanning_tree(df).collect()]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    want = []
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.append((a, b, w))
    assert sorted(tree) == sorted(want)
    assert {r.id: r.root for r in graph.components(df.select("a", "b")).collect()} == {i: 0 for i in range(12)} | {i: 20 for i in (20, 21, 22)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in graph.components(chain).collect()} == {0}


def test_empty_tables(spark):
    s = spark.createDataFrame([], "key long, date date, value double")
    assert correlation.correlate(s).count() == 0
    assert features.risk_features(s).count() == 0
    e = spark.createDataFrame([], "a long, b long, distance double")
    assert graph.minimum_spanning_tree(e).count() == 0 and graph.components(e.select("a", "b")).count() == 0


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, None)], "id int, v string")
    rows = lambda df: sorted(((r.id, r.v) for r in df.collect()), key=str)
    assert rows(store.insert_ignore(old, new, ["id"], [F.col("v")])) == [(1, "a"), (2, "b"), (3, None)]
    assert rows(store.upsert(old, new, ["id"], [F.desc("v")])) == [(1, "a"), (2, "y"), (3, None)]
    assert rows(store.delete_matching(old, new, ["id"])) == [(1, "a")]
    assert store.work_queue(old, new, ["id"]).count() + store.surviving(old, new, ["id"]).count() == old.count()
    assert rows(store.update_from(old, new.where("id <> 2"), ["id"], "v", "v")) == [(1, "a"), (2, "b")]


def test_risk_features_against_numpy(spark):
    s = walk(spark, 3, 150).withColumn("value", F.col("value") + 1e7)
    got = {r.key: r for r in features.risk_features(s).collect()}
    for k in range(3):
        v = np.array([r.value for r in s.where(F.col("key") == k).orderBy("date").collect()])
        r = v[1:] / v[:-1] - 1
        x = got[k]
        assert np.isclose(x.mean_return, r.mean()) and np.isclose(x.std_return, r.std(ddof=1))
        assert np.isclose(x.var_95, np.quantile(r, 0.05)) and np.isclose(x.cvar_95, r[r <= np.quantile(r, 0.05)].mean())
        grown = np.cumprod(1 + r)
        assert np.isclose(x.max_drawdown, (grown / np.maximum.accumulate(grown) - 1).min())


def test_dense_kernels():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, (15, 3)), rng.normal(5, 0.2, (15, 3))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    y = dense.classical_mds(d, 3)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), d)
    labels = dense.cut_tree(dense.linkage(d), 2)
    assert list(labels) == [0] * 15 + [1] * 15 and dense.silhouette(d, labels) > 0.9
    found, strength = dense.density_clusters(d, 3)
    assert len(set(found[:15]) & set(found[15:]) - {-1}) == 0 and ((0 <= strength) & (strength <= 1)).all()
    w, order = dense.risk_parity(np.cov(rng.normal(size=(5, 100))))
    assert np.isclose(w.sum(), 1) and (w > 0).all() and sorted(order) == list(range(5))
    z = dense.tsne(x, rounds=150)
    assert np.linalg.norm(z[:15].mean(0) - z[15:].mean(0)) > z[:15].std()


def test_clusters_of_points(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(10 * (i % 3), 0.5, 2)), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, x double, y double, truth int")
    got = clustering.kmeans(df, ["x", "y"], k=3)
    both = got.join(df, "key").select("key", F.col("cluster").alias("first"), F.col("truth").alias("second"))
    assert np.isclose(validation.adjusted_rand(both).first().ari, 1.0)
    coords, loadings, shares = clustering.principal_components(df, ["x", "y"])
    assert coords.count() == 60 and loadings.count() == 4 and sum(r.variance for r in shares.collect()) <= 1 + 1e-9


def test_series_gaps_and_nulls(spark):
    s = spark.createDataFrame([(1, "2024-01-01", 1.0), (1, "2024-01-02", None), (1, "2024-01-03", 2.0), (1, "2024-01-04", 0.0), (1, "2024-01-05", 3.0)], "key long, date string, value double")
    assert [r.r for r in series.relative_changes(s).orderBy("date").collect()] == [0.0, 1.0, -1.0]


def test_schemas(spark, tmp_path):
    first = tables.initialise(spark, str(tmp_path / "store"))
    assert tables.initialise(spark, str(tmp_path / "store")) == first
    got = tables.conform(spark.createDataFrame([(1, "x")], "field int, other string"), tables.FIELDS)
    assert got.columns == [c.split()[0] for c in tables.FIELDS.split(", ")] and got.first().field == "1"


def test_volatilities_of_all_paired_keys_count(spark, monkeypatch):
    monkeypatch.setattr(clustering, "MOST_DENSE", 3)
    pairs = spark.createDataFrame([("x", "y", 0.5), ("x", "z", 0.1), ("y", "z", 0.2)], "a string, b string, corr double")
    own = [("x", 0.1), ("y", 0.2), ("z", 0.4)]
    more = spark.createDataFrame([*((f"k{i}", 9.0) for i in range(9)), *own], "key string, std_return double")
    weights = lambda v: sorted((r.key, round(r.weight, 9)) for r in clustering.risk_parity(pairs, v).collect())
    assert weights(more.coalesce(1)) == weights(spark.createDataFrame(own, "key string, std_return double"))


def test_a_join_in_cells_gives_the_same_and_shuffles_no_joined_rows(spark):
    import inspect

    from heliograph.plans import QUERIES

    s = walk(spark, 9, 120)
    odd = s.unionByName(s.limit(9).withColumn("date", F.lit(None).cast("date"))).unionByName(s.limit(9).withColumn("key", F.lit(None).cast("long")))
    want = pairs(correlation.pairs_by_join(s))
    for joined in (1, 400, 10**6):
        assert pairs(correlation.pairs_by_join(odd, joined=joined)) == want
    assert pairs(correlation.pairs_by_join(s.where("key < 0"), joined=400)) == {}
    plan = correlation.pairs_by_join(s, joined=400)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(i#") == 1 and plan.count("Exchange") == 1 and "Window" in plan
    assert "joined=" in inspect.getsource(QUERIES["m1_pair_correlation_by_join"])
