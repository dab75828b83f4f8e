"""Readers, sinks, paged services, and the kernels that meet in blocks, on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from heliograph import runtime
from heliograph.functions import dense
from heliograph.functions import expressions as X
from heliograph.operators import correlation, features, filters, store, usage, validation
from heliograph.plans import source_queries
from heliograph.sources import paged, tables
from heliograph.streaming import backfill
from pyspark.sql import functions as F
from test_operators import walk


def test_tables_are_partitioned_by_region(spark, tmp_path):
    at = tables.initialise(spark, str(tmp_path / "store"))["series"]
    rows = spark.createDataFrame([("a", "2024-01-01", 1.0, "USA"), ("b", "2024-01-01", 2.0, "EUR")], "key string, date string, value double, region string")
    tables.append(rows, at, "series")
    tables.append(rows.limit(1), at, "series")
    got = tables.stored(spark, at, "series").where("region = 'USA'")
    assert got.count() == 2 + (rows.limit(1).first().region == "USA") - 1
    assert "PartitionFilters: [isnotnull(region" in got._jdf.queryExecution().toString() and (tmp_path / "store/series/region=EUR").exists()


def test_operator_catalogues(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"name": "rank", "scope": ["REGULAR"]}, {"name": "mix", "category": "Special"}]')
    (tmp_path / "names.txt").write_text(" rank, ts_mean ,,add\n")
    assert {(r.name, tuple(r.scope or ())) for r in tables.read_operators(spark, str(tmp_path / "list.json")).collect()} == {("rank", ("REGULAR",)), ("mix", ())}
    assert {r.name for r in tables.read_operators(spark, str(tmp_path / "names.txt")).collect()} == {"rank", "ts_mean", "add"}
    (tmp_path / "many.txt").write_text(",".join(f"o{i}" for i in range(tables.MOST_OPERATORS + 1)))
    with pytest.raises(ValueError, match="more than"):
        tables.read_operators(spark, str(tmp_path / "many.txt"))


def test_the_newest_file_counts(spark, tmp_path):
    import os

    for i, (name, region, value) in enumerate([("c", "USA", 1), ("a", "USA", 2), ("b", "EUR", 3)]):
        at = tmp_path / f"{name}.json"
        at.write_text(f'{{"region": "{region}",\n "value": {value}}}')
        os.utime(at, (1_700_000_000 + 60 * i,) * 2)
    assert {(r.region, r.value) for r in tables.latest_file(spark, str(tmp_path), "region").collect()} == {("USA", 2), ("EUR", 3)}


def test_csv_and_json_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "x"), (2, float("nan"), None), (3, 0.9, 'a "b", c'), (4, 0.5, "")], "id long, corr double, name string")
    store.export_csv(rows, str(tmp_path / "csv"), "corr", "id")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*"))).split("\n")
    assert [x.split(",")[0] for x in lines if x and not x.startswith("id")] == ["2", "3", "1", "4"]
    store.write_json(rows, str(tmp_path / "json"))
    back = {r.id: (r.corr, r.name) for r in spark.read.schema(rows.schema).json(str(tmp_path / "json")).collect()}
    assert back == {1: (0.5, "x"), 2: (None, None), 3: (0.9, 'a "b", c'), 4: (0.5, "")}


def test_pages_are_retried_and_flattened(spark):
    got = paged.read_paged(spark, f"{source_queries.__name__}.fetch_records", 100, source_queries._NESTED, limit=7)
    assert got.count() == 100
    flat = tables.flatten_records(got).collect()
    assert len(flat) == sum(source_queries.record(i)["id"] is not None and source_queries.record(i)["settings"]["region"] is not None for i in range(100))
    reader = paged.PagedReader({"fetch": f"{__name__}.flaky", "total": "1", "retries": "2", "wait": "0.01"})
    assert len(list(reader.read(paged.Page(0, 1)))) == 1 and len(_calls) == 3
    with pytest.raises(RuntimeError):
        list(paged.PagedReader({"fetch": f"{__name__}.broken", "total": "1", "retries": "1", "wait": "0.01"}).read(paged.Page(0, 1)))


_calls: list[int] = []


def flaky(offset, limit):
    _calls.append(offset)
    if len(_calls) < 3:
        raise RuntimeError("busy")
    return [{"id": offset}]


def broken(offset, limit):
    raise RuntimeError("down")


def test_ramp_grows_and_stops_where_most_pages_are_empty():
    ramp, asked = paged.Ramp(), []
    for without in (0, 3, 16, 17):
        asked.append(ramp.pages)
        if not ramp.seen(ramp.pages, without):
            break
    assert asked == [10, 15, 20, 20] and not paged.Ramp().seen(10, 9) and paged.Ramp().seen(10, 8)


def test_grid(spark):
    assert paged.grid(spark, region=["USA", "EUR"], delay=[0, 1], kind=["MATRIX"]).count() == 4


def test_windows_back_cover_the_range():
    got = backfill.windows_back("2024-01-03", "2024-01-20")
    assert got == [("2024-01-14", "2024-01-20"), ("2024-01-07", "2024-01-13"), ("2024-01-03", "2024-01-06")] and backfill.windows_back("2024-02-01", "2024-01-01") == []


def test_kept_frames_expire(spark):
    now, built = [0.0], []

    def build():
        built.append(1)
        return spark.range(3)

    kept = runtime.Kept(10, lambda: now[0])
    first = kept.get("x", build)
    assert kept.get("x", build) is first and first.storageLevel.useMemory and len(built) == 1
    now[0] = 10.0
    kept.expire()
    assert not kept.held and not first.storageLevel.useMemory
    assert kept.get("x", build, 1).count() == 3 and len(built) == 2
    kept.clear()
    assert not kept.held


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        def getConf(self):
            return {}

        def __getattr__(self, name):
            return lambda *a: self

        def isDefined(self):
            return False

        def isLocal(self):
            return False

    context = Context()
    context._jsc = context

    class Session:
        sparkContext = context
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_dir(Session())


def test_filters_of_a_url(spark):
    rows = spark.createDataFrame([(1, "USA", 2.0), (2, "EUR", 3.0), (3, "USA", 0.5), (4, None, 9.0)], "id int, region string, sharpe double")
    keep = lambda q: [r.id for r in rows.where(filters.from_url("http://x/y" + q, {"settings.region": "region", "is.sharpe": "sharpe"})).orderBy("id").collect()]
    assert keep("?settings.region=USA&is.sharpe%3E1&limit=5") == [1] and keep("?is.sharpe<=2&is.sharpe!=2.0") == [3] and keep("") == [1, 2, 3, 4] and keep("?order=-x") == [1, 2, 3, 4]


def test_expressions_of_a_table_once_each(spark):
    rows = spark.createDataFrame([(1, "USA", "rank(close) + rank(open)"), (2, "USA", "rank(close) + rank(open)"), (3, None, "rank(close)"), (4, "EUR", "rank(close)"), (5, "USA", None), (6, "USA", "close - close--open"), (7, None, None)], "id int, region string, code string")
    fields = spark.createDataFrame([("USA", "Close"), ("USA", "open")], "region string, field string")
    p = X.parse(rows, ["rank", "add", "subtract"], fields)
    got = {r.id: (r.operator_counts, r.field_counts, r.excluded) for r in p.collect()}
    assert got[1] == got[2] == ({"rank": 2, "add": 1}, {"close": 1, "open": 1}, False)
    assert got[3] == ({"rank": 1}, {"close": 1}, False) and got[4] == ({"rank": 1}, {}, True)
    assert got[5] == got[7] == ({}, {}, False) and got[6] == ({"subtract": 3}, {"close": 2, "open": 1}, False)
    stats = usage.batch_statistics(p).first()
    assert tuple(stats) == (7, 6, 1, round(100 / 7, 2))
    report = {(r.kind, r.token): (r.unique_count, r.nominal_count) for r in usage.batch_analysis(p).collect()}
    assert report["operator", "rank"] == (3, 5) and report["field", "close"] == (4, 5) and report["excluded", "Unrecognized components: datafield:close"] == (1, 1)
    cache = p.where("id < 3")
    again = X.parse_missing(rows, cache, ["rank", "add", "subtract"], fields)
    assert {r.id: (r.operator_counts, r.field_counts, r.excluded) for r in again.collect()} == got


def test_rolling_correlations_against_a_plain_loop(spark):
    s = walk(spark, 5, 200)
    got = {(r.a, r.b): r.corr for r in correlation.rolling(s, windows=(40, 60)).collect()}
    of = {k: {r.date: r.value for r in s.where(F.col("key") == k).collect()} for k in range(5)}
    for a in range(5):
        for b in range(a + 1, 5):
            days = sorted(of[a].keys() & of[b].keys())
            x, y = (np.array([of[k][d] for d in days]) for k in (a, b))
            r, t = np.diff(x) / (x[:-1] + 1e7), np.diff(y) / (y[:-1] + 1e7)
            m = [np.median([np.corrcoef(r[i : i + w - 1], t[i : i + w - 1])[0, 1] for i in range(len(r) - w + 2)]) if len(r) >= w - 1 else 0.0 for w in (40, 60)]
            assert np.isclose(got[a, b], (m[0] + m[1] / 2) / 1.5, atol=1e-9)


def test_silhouette_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(90, 3)), rng.integers(0, 4, 90)
    c[0] = 9  # alone in its cluster
    points = spark.createDataFrame([(i, int(c[i]), [float(v) for v in x[i]]) for i in range(90)], "key int, cluster int, vector array<double>")
    d, want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for i in range(90):
        own = (c == c[i]) & (np.arange(90) != i)
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        want.append((b - d[i, own].mean()) / max(b, d[i, own].mean()) if own.any() else 0.0)
    for size in (7, 8192):
        monkeypatch.setattr(validation, "BLOCK_POINTS", size)
        got = validation.silhouette(points).first()
        assert got.n == 90 and np.isclose(got.silhouette, np.mean(want))


def test_hurst_exponents():
    rng = np.random.default_rng(0)
    assert features.hurst_of(np.ones(100)) == 0.5 and features.hurst_of(rng.normal(size=3)) == 0.5
    assert 0.4 < features.hurst_of(rng.normal(size=2000)) < 0.75 < features.hurst_of(np.cumsum(rng.normal(size=2000)))


def test_neighbour_layout_keeps_neighbours_together():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, (40, 4)), rng.normal(6, 0.3, (40, 4)), rng.normal(-6, 0.3, (40, 4))])
    y = dense.neighbour_layout(x)
    group = np.repeat(np.arange(3), 40)
    d, e = dense.distances(x), dense.distances(y)
    near = np.argsort(e, 1)[:, 1:11]
    assert (group[near] == group[:, None]).mean() > 0.95
    true = np.argsort(d, 1)[:, 1:16]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near, true, strict=True)]) > 0.5
    a, b = dense._decay(0.1)
    assert 1.2 < a < 2.2 and 0.7 < b < 1.1  # about 1.58 and 0.90 by a fit of the curve itself
