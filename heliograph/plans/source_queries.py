"""Queries over readers and sinks: files are written from the tables, read back and held against what they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import clustering as K
from heliograph.operators import gathered as B
from heliograph.operators import filters, store
from heliograph.plans.registry import day, query, r6
from heliograph.plans.series_queries import _P
from heliograph.runtime import scratch
from heliograph.sources import paged
from heliograph.sources import tables as T

_S = f"WITH {T.SIGNALS_SQL} "
_OPERATORS = """SELECT lower(replace(n_name, ' ', '_')) AS name, CASE n_regionkey WHEN 1 THEN ['COMBO'] WHEN 2 THEN ['SELECTION'] WHEN 3 THEN ['REGULAR', 'COMBO'] ELSE ['REGULAR'] END AS scope,
  CASE WHEN n_regionkey = 4 AND n_name > 'J' THEN 'Special' ELSE 'Arithmetic' END AS category FROM nation"""


def _operators(spark, d):
    scope = F.when(F.col("n_regionkey") == 1, F.array(F.lit("COMBO"))).when(F.col("n_regionkey") == 2, F.array(F.lit("SELECTION"))).when(F.col("n_regionkey") == 3, F.array(F.lit("REGULAR"), F.lit("COMBO"))).otherwise(F.array(F.lit("REGULAR")))
    category = F.when((F.col("n_regionkey") == 4) & (F.col("n_name") > "J"), "Special").otherwise("Arithmetic")
    return T.table(spark, d, "nation").select(F.lower(F.translate("n_name", " ", "_")).alias("name"), scope.alias("scope"), category.alias("category"))


@query("s8_operator_catalogue", f"SELECT name, CASE WHEN category = 'Special' THEN 'special' WHEN scope = ['COMBO'] THEN 'combo only' WHEN scope = ['SELECTION'] THEN 'selection only' ELSE 'kept' END AS reason FROM ({_OPERATORS})")
def s8_json(spark, d):
    at = scratch(spark, "operators")
    _operators(spark, d).agg(F.to_json(F.struct(F.collect_list(F.struct("name", "scope", "category")).alias("operators"))).alias("value")).write.text(at)
    return T.read_operators(spark, at).select("name", F.coalesce(filters.catalogue_reason(F.col("category"), F.col("scope")), F.lit("kept")).alias("reason"))


@query("s8_operator_names", "SELECT lower(replace(n_name, ' ', '_')) AS name FROM nation")
def s8_text(spark, d):
    at = scratch(spark, "operators") + ".txt"
    store.export_names(_operators(spark, d), at)
    return T.read_operators(spark, at).select("name")


@query("s10_csv", "SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_acctbal AS score FROM supplier")
def s10(spark, d):
    at = scratch(spark, "csv")
    T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score")).write.csv(at, header=True)
    read = T.read_csv(spark, at)
    return read.withColumn("score", F.col("score").cast("double"))


@query("s11_latest_json", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s11(spark, d):
    """An older file of each region, and a newer one that counts."""
    import time

    at = scratch(spark, "latest")
    n, r = T.table(spark, d, "nation"), T.table(spark, d, "region")
    counts = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"))
    counts.withColumn("n", F.lit(0)).write.option("maxRecordsPerFile", 1).json(at)
    time.sleep(1.1)  # file systems tell seconds
    counts.write.option("maxRecordsPerFile", 1).mode("append").json(at)
    return T.latest_file(spark, at, "region").select("region", "n")


RECORDS = 1000


def record(i: int) -> dict:
    """Nested record i of a service: some lack an id or a region."""
    own = {"region": ["USA", "EUR", None, "ASI"][i % 4], "universe": f"TOP{i % 3}", "delay": i % 2}
    return {"id": None if i % 50 == 49 else f"a{i}", "type": "REGULAR", "settings": own, "is": {"sharpe": i / 8, "fitness": i / 16, "riskNeutralized": {"sharpe": -i / 4}}, "regular": {"code": f"rank(f{i})"}}


def fetch_records(offset: int, limit: int) -> list[dict]:
    """A page of the service, as a fetch function of the paged source."""
    return [record(i) for i in range(offset, min(offset + limit, RECORDS))]


_NESTED = "id string, type string, settings struct<region: string, universe: string, delay: int>, is struct<sharpe: double, fitness: double, riskNeutralized: struct<sharpe: double>>, regular struct<code: string>"
_RECORDS_SQL = "SELECT 'a' || i AS id, ['USA', 'EUR', NULL, 'ASI'][i % 4 + 1] AS region, 'TOP' || (i % 3) AS universe, (i % 2)::INT AS delay, i / 8 AS sharpe, -i / 4 AS neutral_sharpe, 'rank(f' || i || ')' AS code FROM range(1000) t(i) WHERE i % 50 != 49 AND i % 4 != 2"


@query("s12_paged_records", _RECORDS_SQL)
def s12(spark, d):
    got = paged.read_paged(spark, f"{__name__}.fetch_records", RECORDS, _NESTED, limit=64)
    return T.flatten_records(got).select("id", "region", "universe", "delay", "sharpe", "neutral_sharpe", "code")


@query("r2_ramped_records", _RECORDS_SQL)
def r2(spark, d):
    """The same without a count of the records: pages are asked for until most are empty."""
    got = paged.read_until_empty(spark, f"{__name__}.fetch_records", _NESTED, limit=16)
    return T.flatten_records(got).select("id", "region", "universe", "delay", "sharpe", "neutral_sharpe", "code")


@query("s13_recordset", "SELECT o_custkey AS key, o_orderdate::DATE::VARCHAR AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2")
def s13(spark, d):
    o = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    row = F.array(F.date_format("date", "yyyy-MM-dd"), F.col("value").cast("string"), F.lit("more"))
    sets = o.groupBy("key").agg(F.collect_list(row).alias("records"))
    broken = sets.select("key", F.array(F.array(F.lit("not a date"), F.lit("1")), F.array(F.lit("2024-01-01")), F.array().cast("array<string>")).alias("records"))
    return T.flatten_recordset(sets.unionByName(broken)).withColumn("date", day())


@query("s16_flat_records", "SELECT s_name AS id, r_name AS region, 'REGULAR' AS kind, s_acctbal AS sharpe, n_name AS universe, (s_suppkey % 3)::INT AS delay FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name != 'ASIA' WHERE r_name IS NOT NULL")
def s16(spark, d):
    s = T.signals(spark, d)
    nested = s.select(
        F.col("name").alias("id"),
        F.lit("REGULAR").alias("type"),
        F.struct(F.when(F.col("region") != "ASIA", F.col("region")).alias("region"), "universe", "delay").alias("settings"),
        F.struct(F.col("score").alias("sharpe"), F.lit(None).cast("double").alias("fitness"), F.struct(F.lit(None).cast("double").alias("sharpe")).alias("riskNeutralized")).alias("is"),
        F.struct(F.lit("x").alias("code")).alias("regular"),
    )
    return T.flatten_records(nested).select("id", "region", "kind", "sharpe", "universe", "delay")


@query("s6_unsubmitted_series", f"WITH {T.SERIES_SQL}, {T.SIGNALS_SQL} SELECT key, date::VARCHAR AS date, round(value, 4) + 0.0 AS value FROM series WHERE key IN (SELECT id FROM signals WHERE kind = 'UNSUBMITTED')")
def s6(spark, d):
    ids = T.signals(spark, d).where("kind = 'UNSUBMITTED'").select(F.col("id").alias("key"))
    return T.series(spark, d).join(ids, "key", "left_semi").select("key", day(), r6("value", 4).alias("value"))


@query("s14_by_url", _S + "SELECT id FROM signals WHERE region = 'ASIA' AND score >= 1000 AND delay != 1")
def s14_url(spark, d):
    url = "https://service.example/signals?limit=50&offset=0&settings.region=ASIA&is.score%3E=1000&settings.delay!=1&order=-score"
    return T.signals(spark, d).where(filters.from_url(url, {"settings.region": "region", "is.score": "score", "settings.delay": "delay"})).select("id")


@query("s14_by_window", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice >= 150000 AND o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate <= TIMESTAMP '1995-08-31'")
def s14_window(spark, d):
    o = T.table(spark, d, "orders")
    return o.where(filters.beyond(F.col("o_totalprice"), 150000) & filters.selection(date_from="1995-03-01", date_to="1995-08-31", added="o_orderdate")).select(F.col("o_orderkey").alias("id"))


_LINES = "SELECT l_suppkey AS id, l_shipdate::DATE AS date, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2"
_ORDERS = "SELECT o_custkey AS id, o_orderdate::DATE AS date, max(o_totalprice) AS value FROM orders GROUP BY 1, 2"


@query("k4_insert_ignore_series", f"WITH old AS ({_ORDERS}), new AS ({_LINES}) SELECT id, date::VARCHAR AS date, round(value, 2) AS value FROM (SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.id = n.id AND o.date = n.date))")
def k4(spark, d):
    old = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("value"))
    new = T.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_extendedprice").alias("value"))
    return store.insert_ignore(old, new, ["id", "date"], [F.col("value")]).select("id", day(), F.round("value", 2).alias("value"))


@query("k6_truncate_and_load", _S + "SELECT id, region, CASE WHEN region = 'ASIA' THEN score + 1 ELSE score END AS score FROM signals WHERE kind != 'SUPER' OR region = 'ASIA'")
def k6(spark, d):
    """All of the table is replaced by what isn't SUPER, then one partition by all of its rows with another score."""
    at, s = scratch(spark, "loaded"), T.signals(spark, d).select("id", "region", "kind", "score")
    store.truncate_and_load(s, at, "region")
    store.truncate_and_load(s.where("kind != 'SUPER'"), at, "region")
    store.replace_partitions(s.where("region = 'ASIA'").withColumn("score", F.col("score") + 1), at, "region")
    return spark.read.parquet(at).select("id", "region", "score")


@query("k12_json", _S + "SELECT id, region, CASE WHEN score < 0 THEN NULL ELSE score END AS score FROM signals")
def k12(spark, d):
    at = scratch(spark, "json")
    store.write_json(T.signals(spark, d).select("id", "region", F.when(F.col("score") < 0, F.lit(float("nan"))).otherwise(F.col("score")).alias("score")), at)
    return spark.read.schema("id long, region string, score double").json(at)


@query("k13_csv", "SELECT c_custkey AS id, c_acctbal AS correlation, o AS self_corr FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def k13_csv(spark, d):
    at = scratch(spark, "export")
    store.export_csv(T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("correlation"), F.lit("").alias("self_corr")), at, "correlation", "id")
    values = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("self_corr"))
    return store.enriched(T.read_csv(spark, at, "id long, correlation double, self_corr string"), values, "id", "self_corr").select("id", "correlation", "self_corr")


@query("k14_cache", "SELECT 'built' AS run, count(*) AS n FROM nation UNION ALL SELECT 'kept', count(*) FROM nation UNION ALL SELECT 'stale', count(*) FROM region")
def k14_cache(spark, d):
    """Built at first, then kept while it is fresh, then built anew."""
    at, n, r = scratch(spark, "cache"), T.table(spark, d, "nation").select(F.col("n_name").alias("name")), T.table(spark, d, "region").select(F.col("r_name").alias("name"))
    count = lambda df, run: spark.createDataFrame([(run, df.count())], "run string, n long")
    built, kept = count(store.cached(spark, at, 7, lambda: n), "built"), count(store.cached(spark, at, 7, lambda: r), "kept")
    later = F.current_timestamp() + F.expr("INTERVAL 8 DAYS")
    return built.unionByName(kept).unionByName(count(store.cached(spark, at, 7, lambda: r, later), "stale"))


@query("k15_schemas", "SELECT * FROM (VALUES ('signals', 23, true), ('series', 4, true), ('correlations', 7, true), ('best_matches', 5, true), ('parsed', 8, false), ('fields', 7, true), ('operators', 3, false)) t(name, columns, by_region)")
def k15(spark, d):
    at = T.initialise(spark, scratch(spark, "store"))
    row = lambda n, p: (n, len(T.stored(spark, p, n).columns), T.partitioned(n))
    return spark.createDataFrame([row(n, p) for n, p in at.items()], "name string, columns int, by_region boolean")


@query("p2_whole_table_rule", "SELECT * FROM (VALUES (1, false), (2, false), (3, true), (4, true)) t(id, given)")
def p2(spark, d):
    cases = [(1, filters.any_given(None, "", None)), (2, filters.any_given(None, 0)), (3, filters.any_given("USA", 0)), (4, filters.any_given(None, 1))]
    return spark.createDataFrame(cases, "id int, given boolean")


@query("p11_more_validators", """SELECT o_orderkey AS id, o_orderpriority IN ('1-URGENT', '2-HIGH') AS valid_region, o_shippriority BETWEEN 1 AND 65535 AS valid_port, o_orderdate <= TIMESTAMP '1996-01-01' AS valid_dates, o_custkey % 2 = 0 AS valid_path, o_orderstatus != 'F' AS valid_json FROM (SELECT *, o_custkey % 3 AS o_shippriority FROM orders)""")
def p11(spark, d):
    path = F.when(F.col("o_custkey") % 2 == 0, F.concat("o_orderpriority", F.lit(".JSON"))).when(F.col("o_custkey") % 4 == 1, F.concat(F.lit("../"), "o_orderpriority", F.lit(".json"))).otherwise(F.lit("x.exe"))
    text = F.when(F.col("o_orderstatus") == "F", '{"region": 1}').otherwise(F.to_json(F.struct(F.col("o_orderstatus").alias("region"), F.lit(1).alias("timestamp"))))
    return T.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        filters.valid_region(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("valid_region"),
        filters.valid_port(F.col("o_custkey") % 3).alias("valid_port"),
        filters.valid_dates(F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp")).alias("valid_dates"),
        filters.valid_path(path, ["json", ".csv"]).alias("valid_path"),
        filters.valid_json(text, ["region", "timestamp"]).alias("valid_json"),
    )


@query("p14_heat_map", f"{_P.replace(' RECURSIVE', '')}, ids AS (SELECT a AS id FROM pairs UNION SELECT b FROM pairs ORDER BY id LIMIT 50) SELECT a, b, round(corr, 6) + 0.0 AS corr FROM pairs WHERE a IN (SELECT id FROM ids) AND b IN (SELECT id FROM ids)")
def p14(spark, d):
    return B.head(T.series(spark, d)).select("a", "b", r6("corr").alias("corr"))


@query("p15_highlights", "SELECT c_custkey AS key, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS operator_match, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS field_match, c_custkey = 7 AS selected FROM customer")
def p15(spark, d):
    o = T.table(spark, d, "orders")
    points = T.table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return filters.highlighted(points, o.where("o_orderpriority = '1-URGENT'").select("o_custkey"), o.where("o_totalprice > 200000").select("o_custkey"), 7)


@query("j16_labelled_coordinates", _S + "SELECT id AS key, score AS x, delay AS y, CASE WHEN kind != 'SUPER' THEN delay ELSE -1 END AS cluster FROM signals")
def j16(spark, d):
    s = T.signals(spark, d)
    return K.labelled(s.select(F.col("id").alias("key"), F.col("score").alias("x"), F.col("delay").alias("y")), s.where("kind != 'SUPER'").select(F.col("id").alias("key"), F.col("delay").alias("cluster"))).na.fill(-1, ["cluster"])


@query("t2_first_by_id", _S + "SELECT id, name, region, coalesce(universe, 'N/A') AS universe, delay FROM signals WHERE kind = 'REGULAR' ORDER BY id LIMIT 100")
def t2(spark, d):
    """A page of a listing: the first 100 by id."""
    s = T.signals(spark, d).where("kind = 'REGULAR'")
    return s.select("id", "name", "region", filters.default(F.col("universe"), "N/A").alias("universe"), "delay").orderBy("id").limit(100)
