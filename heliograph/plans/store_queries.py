"""Store, filter and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import filters, store, usage
from heliograph.plans.registry import day, query, r6
from heliograph.sources import tables as T

_S = f"WITH {T.SIGNALS_SQL} "


@query("s1_region_scan", _S + "SELECT id FROM signals WHERE region = 'ASIA'")
def s1(spark, d):
    return T.signals(spark, d).where("region = 'ASIA'").select("id")


@query("s2_kind_scan", _S + "SELECT id, name FROM signals WHERE region = 'EUROPE' AND kind = 'REGULAR'")
def s2(spark, d):
    return T.signals(spark, d).where("region = 'EUROPE' AND kind = 'REGULAR'").select("id", "name")


@query("s3_unsubmitted_scan", _S + "SELECT id FROM signals WHERE region = 'EUROPE' AND kind = 'UNSUBMITTED'")
def s3(spark, d):
    return T.signals(spark, d).where("region = 'EUROPE' AND kind = 'UNSUBMITTED'").select("id")


@query("s4_series_of_ids", f"WITH {T.SERIES_SQL}, ids AS (SELECT s_suppkey + 5 AS key FROM supplier) SELECT ids.key, date::VARCHAR AS date, round(value, 4) + 0.0 AS value FROM ids LEFT JOIN series USING (key)")
def s4(spark, d):
    ids = T.table(spark, d, "supplier").select((F.col("s_suppkey") + 5).alias("key"))
    return ids.join(T.series(spark, d), "key", "left").select("key", day(), r6("value", 4).alias("value"))


@query("s5_series_bulk", f"WITH {T.SERIES_SQL}, {T.SIGNALS_SQL} SELECT key, date::VARCHAR AS date, round(value, 4) + 0.0 AS value FROM series WHERE key IN (SELECT id FROM signals WHERE region = 'ASIA')")
def s5(spark, d):
    ids = T.signals(spark, d).where("region = 'ASIA'").select(F.col("id").alias("key"))
    return T.series(spark, d).join(ids, "key", "left_semi").select("key", day(), r6("value", 4).alias("value"))


_OLD = "SELECT o_orderkey AS id, o_orderdate AS ts, o_custkey AS user_id, o_totalprice AS value FROM orders"
_NEW = "SELECT l_orderkey + 7 AS id, l_shipdate AS ts, l_suppkey AS user_id, l_extendedprice AS value FROM lineitem"
_FIRST = "SELECT id, ts, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, user_id, value) AS k FROM new) WHERE k = 1"
_LAST = "SELECT id, ts, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, user_id DESC, value DESC) AS k FROM new) WHERE k = 1"


def _sides(spark, d):
    """A store of orders, and what arrives: lines, with keys that repeat and of which some are new."""
    old = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("value"))
    return old, T.table(spark, d, "lineitem").select((F.col("l_orderkey") + 7).alias("id"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("user_id"), F.col("l_extendedprice").alias("value"))


@query("k2_insert_ignore", f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old UNION ALL SELECT * FROM ({_FIRST}) WHERE id NOT IN (SELECT id FROM old)")
def k2(spark, d):
    old, new = _sides(spark, d)
    return store.insert_ignore(old, new, ["id"], [F.col("ts"), F.col("user_id"), F.col("value")])


@query("k5_upsert", f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL {_LAST}")
def k5(spark, d):
    old, new = _sides(spark, d)
    return store.upsert(old, new, ["id"], [F.desc("ts"), F.desc("user_id"), F.desc("value")])


@query("k7_delete_matching", f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def k7(spark, d):
    old, new = _sides(spark, d)
    return store.delete_matching(old, new, ["id"])


@query("k8_update_from", "SELECT s_suppkey AS id, coalesce(m, s_acctbal) AS score FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON s_suppkey = l_suppkey")
def k8(spark, d):
    old = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    new = T.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("id")).agg(F.max("l_extendedprice").alias("m"))
    return store.update_from(old, new, ["id"], "score", "m")


@query("k11_last_wins", "SELECT l_partkey AS field, l_returnflag AS region, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1")
def k11(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("field"), F.col("l_returnflag").alias("region"), "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return store.distinct_rows(rows, ["field", "region"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_extendedprice")]).drop("l_shipdate", "l_extendedprice")


@query("k13_sorted_export", "SELECT s_suppkey AS id, s_acctbal AS correlation FROM supplier ORDER BY 2 DESC, 1")
def k13(spark, d):
    return T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("correlation")).orderBy(F.desc("correlation"), "id")


@query("k14_freshness", "SELECT event_id, floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400) < 7 AS fresh FROM events")
def k14(spark, d):
    return T.table(spark, d, "events").select("event_id", store.is_fresh(F.col("ts"), 7, F.lit("2024-01-31").cast("timestamp")).alias("fresh"))


@query("cascade_survivors", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def cascade(spark, d):
    parents = T.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.surviving(T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parents, ["l_orderkey"])


@query("p1_filtered_scan", "SELECT o_orderkey AS id, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0 AND o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate <= TIMESTAMP '1997-06-30' AND o_orderpriority != ''")
def p1(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("region"), (F.col("o_custkey") % 3).alias("delay"), F.col("o_orderdate").alias("added"), F.col("o_orderpriority").alias("code"))
    return o.where(filters.selection(region="F", delay=0, date_from="1995-06-01", date_to="1997-06-30", code="code")).select("id", "code")


_BRANDS = "brands AS (SELECT l_suppkey AS id, list(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def _brands(spark, d):
    lines, parts = T.table(spark, d, "lineitem"), T.table(spark, d, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set("p_brand").alias("brands"))


@query("p4_contains_any", f"WITH {_BRANDS} SELECT id, len(brands) AS n FROM brands WHERE list_has_any(brands, ['Brand#1', 'Brand#2'])")
def p4(spark, d):
    return _brands(spark, d).where(filters.contains_any(F.col("brands"), ["Brand#1", "Brand#2"])).select("id", F.size("brands").cast("long").alias("n"))


@query("p5_contains", f"WITH {_BRANDS} SELECT id FROM brands WHERE list_contains(brands, 'Brand#7')")
def p5(spark, d):
    return _brands(spark, d).where(F.array_contains("brands", "Brand#7")).select("id")


@query("p7_existence", "SELECT c_custkey AS id, c_mktsegment AS kind, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS there FROM customer")
def p7(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    o = T.table(spark, d, "orders").where("o_orderdate >= '1998-01-01'").select(F.col("o_custkey").alias("id"))
    return store.with_existence(c, o, ["id"], "there")


@query("p9_defaults", "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'N/A' ELSE c_mktsegment END AS segment FROM customer")
def p9(spark, d):
    c = T.table(spark, d, "customer").withColumn("segment", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")))
    return c.select(F.col("c_custkey").alias("id"), filters.default(F.col("segment"), "N/A").alias("segment"))


@query("p11_validators", "SELECT p_partkey AS id, regexp_full_match(p_brand, '[A-Za-z0-9_-]{3,50}') AS valid_id, p_size BETWEEN 0 AND 30 AS valid_delay, p_retailprice BETWEEN 901 AND 1000 AS valid_price FROM part")
def p11(spark, d):
    p = T.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), filters.valid_id(F.col("p_brand")).alias("valid_id"), filters.valid_delay(F.col("p_size")).alias("valid_delay"), filters.valid_number(F.col("p_retailprice"), 901, 1000).alias("valid_price"))


@query("p13_signed_threshold", "SELECT s_suppkey AS id, s_acctbal >= 5000 AS above, s_acctbal <= -500 AS below FROM supplier")
def p13(spark, d):
    return T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), filters.beyond(F.col("s_acctbal"), 5000).alias("above"), filters.beyond(F.col("s_acctbal"), -500).alias("below"))


@query("p16_filter_options", _S + "SELECT 'region' AS option, region AS value FROM signals UNION SELECT 'universe', universe FROM signals UNION SELECT 'delay', delay::VARCHAR FROM signals")
def p16(spark, d):
    return usage.value_counts(T.signals(spark, d), ["region", "universe", "delay"]).select(F.col("column").alias("option"), "value")


@query("j1_dimension_join", _S + "SELECT region, kind, count(*) AS n, round(avg(score), 4) + 0.0 AS score FROM signals GROUP BY 1, 2")
def j1(spark, d):
    return T.signals(spark, d).groupBy("region", "kind").agg(F.count("*").alias("n"), r6(F.avg("score"), 4).alias("score"))


@query("j4_work_queue", "SELECT s_suppkey AS id FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_discount = 0.1)")
def j4(spark, d):
    done = T.table(spark, d, "lineitem").where("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_suppkey").alias("id"))
    return store.work_queue(T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), done, ["id"])


@query("j6_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j6(spark, d):
    lines = T.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_semi")


@query("j12_left_enrichment", "SELECT c_custkey AS key, n_name, spent FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def j12(spark, d):
    c, n = T.table(spark, d, "customer"), T.table(spark, d, "nation")
    o = T.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").join(o, c.c_custkey == o.o_custkey, "left").select(F.col("c_custkey").alias("key"), "n_name", "spent")


@query("j14_flatten_struct", "SELECT event_id, (props::JSON->>'k')::BIGINT AS props_k FROM events")
def j14(spark, d):
    e = T.table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", F.col("p.k").alias("props_k"))


@query("j17_parameter_grid", "SELECT r_name AS region, n_name AS universe, d AS delay FROM region, nation, (VALUES (0), (1)) t(d)")
def j17(spark, d):
    r, n = T.table(spark, d, "region").select(F.col("r_name").alias("region")), T.table(spark, d, "nation").select(F.col("n_name").alias("universe"))
    return r.crossJoin(n).crossJoin(spark.createDataFrame([(0,), (1,)], "delay int"))


@query("t1_top_scores", _S + "SELECT DISTINCT id, score FROM signals WHERE region = 'ASIA' ORDER BY score DESC NULLS LAST, id LIMIT 50")
def t1(spark, d):
    return T.signals(spark, d).where("region = 'ASIA'").select("id", "score").distinct().orderBy(F.desc_nulls_last("score"), "id").limit(50)


@query("u1_set_operations", _S + "SELECT universe, 'both' AS kind FROM (SELECT universe FROM signals WHERE kind = 'SUPER' INTERSECT SELECT universe FROM signals WHERE delay = 0) UNION ALL SELECT universe, 'one' FROM (SELECT universe FROM signals EXCEPT SELECT universe FROM signals WHERE kind = 'SUPER' AND delay = 0)")
def u1(spark, d):
    s = T.signals(spark, d)
    u = lambda c=None: (s.where(c) if c else s).select("universe")
    both = u("kind = 'SUPER'").intersect(u("delay = 0")).withColumn("kind", F.lit("both"))
    return both.unionByName(u().subtract(u("kind = 'SUPER' AND delay = 0")).withColumn("kind", F.lit("one")))


@query("m43_best_value_column", "WITH p AS (SELECT l_suppkey AS key, l_shipdate::DATE AS date, max(l_extendedprice) AS a, max(l_quantity * 1000) AS b FROM lineitem GROUP BY 1, 2), w AS (SELECT key, arg_max(b, date) - arg_min(b, date) > arg_max(a, date) - arg_min(a, date) AS second FROM p GROUP BY 1) SELECT key, date::VARCHAR AS date, CASE WHEN second THEN b ELSE a END AS value FROM p JOIN w USING (key)")
def m43(spark, d):
    p = T.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("a"), F.max(F.col("l_quantity") * 1000).alias("b"))
    return T.best_value_column(p, "key", "date", "a", "b").withColumn("date", day())
