"""What keeps the time, memory and disk of a query from growing faster than its input."""

from __future__ import annotations

import numpy as np
from heliograph.operators import features, validation
from heliograph.plans import QUERIES, cluster_queries
from heliograph.sources import tables
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_of_models_are_computed_once(spark, sf):
    got = plan(cluster_queries._features(spark, sf))
    assert "Window" not in got and "Aggregate" not in got


def test_risk_features_are_computed_once_for_medians_and_rows(spark, sf):
    assert "FlatMapGroupsInArrow" not in plan(features.risk_features(tables.series(spark, sf)))


def test_distances_by_products(monkeypatch):
    rng = np.random.default_rng(5)
    x, far = rng.normal(size=(40, 7)), rng.normal(size=(30, 7))
    y = np.concatenate([x[:20], x[20:] + 1e-9, far])  # equal, almost equal and other rows
    monkeypatch.setattr(validation, "HELD", 64)
    want = np.sqrt(((x[:, None] - y) ** 2).sum(2))
    got = validation.distances(x, y)
    assert np.allclose(got, want, rtol=1e-9, atol=0) and (got[np.arange(20), np.arange(20)] == 0).all()


def test_correlations_are_finished_a_tile_at_a_time():
    from heliograph.operators import correlation

    rng, days = np.random.default_rng(6), np.arange(90)
    grown = 1e7 * (1.01**days - 1)
    series = [np.cumsum(rng.normal(size=90)) * 1e4, grown + 1e-3 * np.sin(days), np.full(90, 3.0), np.where(days == 5, -1e7, days)]
    dates = [days[: 40 + 10 * k] for k in range(4)]
    flat, edges = np.concatenate([s[d] for s, d in zip(series, dates, strict=True)]), np.cumsum([0, *map(len, dates)])
    for x in (series[0], grown + 1e-3 * np.sin(days + 1)):
        args = x, np.ones(90, bool), np.concatenate(dates), flat, edges
        n, corr = correlation.kernel(*args, 20, 1e7)
        days_, sums = correlation.moments(*args, 1e7)
        m, c, odd = correlation.of_moments(days_, list(sums), 20)
        assert (m == n).all() and np.allclose(c[~odd], corr[~odd], rtol=0, atol=1e-8, equal_nan=True) and odd[1]


def test_rolling_correlations_of_few_long_pairs_dont_widen_the_others(monkeypatch):
    from heliograph.operators import correlation

    held, wide, medians = {}, [], correlation.rolling_medians
    monkeypatch.setattr(correlation, "meet", lambda left, right, kernel, columns: held.update(kernel=kernel))
    monkeypatch.setattr(correlation, "rolling_medians", lambda r, s, n, *more: wide.append((r.size, n.sum())) or medians(r, s, n, *more))
    correlation.rolling(None)
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.normal(size=600)) * 1e4
    dates = [np.arange(600), *[np.sort(rng.permutation(600)[: 70 + k]) for k in range(30)], np.arange(40)]
    flat = [x[d] + np.cumsum(rng.normal(size=len(d))) * 1e4 for d in dates]
    ask = lambda d, v: held["kernel"](x, np.ones(600, bool), np.concatenate(d), np.concatenate(v), np.cumsum([0, *map(len, d)]))
    n, corr = ask(dates, flat)
    assert sum(a for a, _ in wide) < 1.3 * sum(b for _, b in wide)
    alone = [ask([d], [v]) for d, v in zip(dates, flat, strict=True)]
    assert (n == [a[0] for a, _ in alone]).all() and np.allclose(corr, [b[0] for _, b in alone], rtol=0, atol=1e-12) and corr[-1] == 0 and (corr[:-1] != 0).any()


def test_ids_of_several_regions_count_once_in_all(spark):
    from heliograph.operators import usage

    rows = [(1, "f", "a"), (1, "f", "b"), (2, "f", "a"), (2, "f", "a"), (3, "f", None), (None, "f", "a"), (1, "g", "b"), (None, "h", "b")]
    used = spark.createDataFrame(rows, "id long, field string, region string")
    want = used.rollup("field", "region").agg(F.countDistinct("id").alias("signals")).where("field IS NOT NULL")
    key = lambda r: (r.field, str(r.region), r.signals)
    assert sorted(map(key, usage.usage_by_region(used, "field").collect())) == sorted(map(key, want.collect()))


def test_usage_is_shuffled_once_into_tasks_of_bounded_rows(spark, sf, monkeypatch):
    import re

    monkeypatch.setattr(tables, "ROWS", 500)
    for name in ("a8_usage_by_region", "a16_usage_bands", "a1_token_usage"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        lines = tables.table(spark, sf, "lineitem").count()
        assert re.findall(r"hashpartitioning\(id#\w+, field#\w+, (\d+)\)", plan) == [str(-(-lines // 500))], name
        assert not re.search(r"Exchange hashpartitioning\([^)]*\bid#[^)]*\), ENSURE", plan.replace("spark_grouping_id", "")), name


def test_ids_are_counted_by_distinct_expressions(spark):
    from heliograph.functions import expressions
    from heliograph.operators import usage

    codes = ["rank(a) + b", "rank(b)", "a * a", "mystery(a)", None, "rank(nothing)"]
    ids = [(i // 3 if i % 4 else i, codes[i * 7 % 6]) for i in range(60)] + [(1, codes[0]), (1, codes[0]), (None, codes[1]), (None, codes[2])]
    rows = spark.createDataFrame(ids, "id long, code string").withColumn("region", F.lit("A"))
    fields = spark.createDataFrame([("A", "a", "x"), ("A", "b", "x"), ("A", "b", "y")], "region string, field string, category string")
    available = ["rank", "add", "multiply"]
    whole, apart = expressions.parse(rows, available, fields), expressions.parse_apart(rows, available, fields)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(usage.analysis_of_distinct(*apart)) == key(usage.batch_analysis(whole))
    assert key(usage.categories_of_distinct(*apart, fields)) == key(usage.batch_categories(whole, fields.select("field", "category")))


def test_lines_are_not_repeated_for_their_tokens(spark, sf):
    for name in ("x_parser_table", "x19_batch_categories"):
        text = plan(QUERIES[name](spark, sf))
        assert "RepartitionByExpression [id" in text and "count(distinct id#" not in text, name
