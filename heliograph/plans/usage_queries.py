"""Expression and usage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import expressions as X
from heliograph.operators import store
from heliograph.operators import usage as U
from heliograph.plans.registry import day, query, r6
from heliograph.sources import tables as T

_U = f"WITH {T.USAGE_SQL} "
_UF = f"WITH {T.USAGE_SQL}, {T.FIELDS_SQL} "
AVAILABLE = ["rank", "ts_mean", "add", "subtract", "multiply", "divide", "less", "greater", "equal", "if_else", "group_neutralize"]
CASES = [
    (1, "USA", "rank(ts_mean(close, 5))"), (2, "USA", "close - open + close"), (3, "USA", "x = rank(volume); x * close"), (4, "USA", "rank(foo)"),
    (5, "USA", "mystery(close)"), (6, "USA", "close == open"), (7, "USA", "close <= 5"), (8, "USA", "close > open ? close : open"),
    (9, "USA", 'group_neutralize(close, "open")'), (10, "USA", "ts_mean(close, k=1)"), (11, "USA", None), (12, "EUR", "rank(open)"),
]
_EXPECTED = """SELECT * FROM (VALUES
 (1, 'rank:1,ts_mean:1', 'rank,ts_mean', 'close:1', false, NULL), (2, 'add:1,subtract:1', 'add,subtract', 'close:2,open:1', false, NULL),
 (3, 'multiply:1,rank:1', 'multiply,rank', 'close:1,volume:1', false, NULL), (4, 'rank:1', 'rank', '', true, 'Unrecognized components: datafield:foo'),
 (5, '', '', 'close:1', true, 'Unrecognized components: operator:mystery'), (6, 'equal:1', 'equal', 'open:1', false, NULL),
 (7, 'less:1', 'less', 'close:1', false, NULL), (8, 'greater:1', 'greater,if_else', 'close:2,open:2', false, NULL),
 (9, 'group_neutralize:1', 'group_neutralize', 'close:1', false, NULL), (10, 'ts_mean:1', 'ts_mean', 'close:1', false, NULL),
 (11, '', '', '', false, NULL), (12, 'rank:1', 'rank', '', true, 'Unrecognized components: datafield:open')) t(id, operator_counts, operators, field_counts, excluded, reason)"""


def _text(counts):
    return F.array_join(F.array_sort(F.transform(F.map_entries(counts), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",")


@query("x_parser_cases", _EXPECTED)
def x_cases(spark, d):
    rows = spark.createDataFrame(CASES, "id int, region string, code string")
    fields = spark.createDataFrame([("USA", f) for f in ("close", "open", "volume")] + [("EUR", "close")], "region string, field string")
    p = X.parse(rows, AVAILABLE, fields)
    return p.select("id", _text(F.col("operator_counts")).alias("operator_counts"), F.array_join("operators", ",").alias("operators"), _text(F.col("field_counts")).alias("field_counts"), "excluded", "reason")


_EXPRESSIONS = """e AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag AS region, 'f' || (l_partkey % 50) AS a, 'f' || (l_suppkey % 50) AS b, l_linenumber = 7 AS odd FROM lineitem),
parsed AS (SELECT *, list_filter([CASE WHEN odd THEN 'operator:mystery' END, CASE WHEN region = 'R' AND a = 'f7' THEN 'datafield:f7' END, CASE WHEN region = 'R' AND b = 'f7' THEN 'datafield:f7' END, CASE WHEN region = 'R' AND a = 'f7' THEN 'datafield:f7' END], lambda x: x IS NOT NULL) AS unknown FROM e),
ok AS (SELECT * FROM parsed WHERE len(unknown) = 0)"""
_USED = f"""{_EXPRESSIONS}, used AS (SELECT id, 'field' AS kind, a AS token, CASE WHEN a = b THEN 3 ELSE 2 END AS n FROM ok UNION ALL SELECT id, 'field', b, 1 FROM ok WHERE a != b
  UNION ALL SELECT id, 'operator', unnest(['rank', 'ts_mean', 'subtract', 'multiply']), 1 FROM ok)"""


def _expressions(spark, d):
    """An expression for each line, some with an operator that isn't available; one field is missing in one region."""
    a, b = F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")), F.concat(F.lit("f"), (F.col("l_suppkey") % 50).cast("string"))
    outer = F.when(F.col("l_linenumber") == 7, "mystery(ts_mean(").otherwise("rank(ts_mean(")
    return T.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("region"), F.concat(outer, a, F.lit(", 5)) - "), b, F.lit(" * "), a).alias("code"))


def _expression_fields(spark):
    fields = spark.range(50).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("field"), F.explode(F.array(*map(F.lit, "ANR"))).alias("region"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("category"))
    return fields.where("NOT (field = 'F7' AND region = 'R')")


def _parsed(spark, d):
    return X.parse(_expressions(spark, d), AVAILABLE, _expression_fields(spark))


def _parsed_apart(spark, d):
    """Rows by id, in partitions of bounded size, and what each distinct expression parses to."""
    rows, parsed = X.parse_apart(_expressions(spark, d), AVAILABLE, _expression_fields(spark))
    return T.spread(rows.select("id", "_same"), "id"), parsed


@query("x_parser_table", f"WITH {_USED} SELECT kind, token, count(DISTINCT id) AS unique_count, sum(n)::BIGINT AS nominal_count FROM used GROUP BY 1, 2 UNION ALL SELECT 'excluded', 'Unrecognized components: ' || array_to_string(unknown, ', '), count(*), count(*) FROM parsed WHERE len(unknown) > 0 GROUP BY 2")
def x_table(spark, d):
    return U.analysis_of_distinct(*_parsed_apart(spark, d))


@query("x19_batch_categories", f"WITH {_USED} SELECT 'c' || (substr(token, 2)::INT % 7) AS category, count(DISTINCT id) AS unique_count, sum(n)::BIGINT AS nominal_count FROM used WHERE kind = 'field' GROUP BY 1")
def x19_categories(spark, d):
    return U.categories_of_distinct(*_parsed_apart(spark, d), _expression_fields(spark).select("field", "category").distinct())


@query("x19_batch_statistics", f"WITH {_EXPRESSIONS} SELECT count(*) AS total, count(*) FILTER (len(unknown) = 0) AS analysed, count(*) FILTER (len(unknown) > 0) AS excluded, round(count(*) FILTER (len(unknown) > 0) * 100.0 / count(*), 2)::DOUBLE AS percent_excluded FROM parsed")
def x19_statistics(spark, d):
    return U.batch_statistics(_parsed(spark, d))


@query("x18_accessible", f"WITH {_EXPRESSIONS} SELECT id, region, len(unknown) = 0 AS accessible, CASE WHEN len(unknown) > 0 THEN 'Unrecognized components: ' || array_to_string(unknown, ', ') END AS reason FROM parsed")
def x18(spark, d):
    return _parsed(spark, d).select("id", "region", (~F.col("excluded")).alias("accessible"), "reason")


@query("r4_incremental_parse", f"WITH {_EXPRESSIONS} SELECT id, count(*) AS n, bool_and(len(unknown) = 0) AS ok FROM parsed GROUP BY 1")
def r4(spark, d):
    """The cache has what came before 1995; the rest is parsed into it, and the parse of what came last is stored anew (K9)."""
    rows = _expressions(spark, d)
    early = T.table(spark, d, "lineitem").where("l_shipdate < '1995-01-01'").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).distinct()
    cache = X.parse(rows.join(early, "id", "left_semi"), AVAILABLE, _expression_fields(spark))
    now = X.parse_missing(rows, cache, AVAILABLE, _expression_fields(spark))
    again = X.parse(rows.join(early, "id", "left_anti"), AVAILABLE, _expression_fields(spark))
    stored = store.delete_matching(now, again, ["id"]).unionByName(again)
    return stored.groupBy("id").agg(F.count("*").alias("n"), F.every(~F.col("excluded")).alias("ok"))


@query("x14_dataset_category", """SELECT d, c FROM (VALUES ('fundamental6', 'Fundamental'), ('Analyst4', 'Analyst'), ('pv1', 'Price Volume'), ('macro9', 'Macroeconomic'), ('alternative2', 'Alternative'), ('technical', 'Technical'), ('x_sentiment', 'Sentiment'), ('newsfeed', 'News'), ('my_esg', 'ESG'), ('cryptic', 'Other'), ('my_crypto', 'Cryptocurrency'), ('', 'Other'), (NULL, 'Other'), ('model77', 'Other')) t(d, c)""")
def x14(spark, d):
    names = ["fundamental6", "Analyst4", "pv1", "macro9", "alternative2", "technical", "x_sentiment", "newsfeed", "my_esg", "cryptic", "my_crypto", "", None, "model77"]
    return spark.createDataFrame([(n,) for n in names], "d string").select("d", X.dataset_category(F.col("d")).alias("c"))


_KINDS = ["fundamental", "ANALYST", "pv", "macro", "alternative", "Tech", "my_sentiment_", "newsfeed", "an_esg", "crypto", "model"]


@query("x14_categories_of_a_table", "SELECT p_partkey AS id, ['Fundamental', 'Analyst', 'Price Volume', 'Macroeconomic', 'Alternative', 'Technical', 'Sentiment', 'News', 'ESG', 'Cryptocurrency', 'Other'][p_size % 11 + 1] AS category FROM part")
def x14_table(spark, d):
    p = T.table(spark, d, "part")
    name = F.concat(F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_size") % 11 + 1).cast("int")), F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), X.dataset_category(name).alias("category"))


@query("x15_dataset_of_field", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_type ELSE 'unknown' END AS dataset FROM part")
def x15(spark, d):
    p = T.table(spark, d, "part")
    f = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit(".a_b"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("_a"))).otherwise(F.col("p_type"))
    return p.select(F.col("p_partkey").alias("id"), X.dataset_of(f).alias("dataset"))


@query("x16_display", "SELECT p_partkey AS id, CASE WHEN length(p_name) <= 9 THEN p_name ELSE substr(p_name, 1, 6) || '...' END AS short, regexp_replace('<' || p_name || '>', '[<>\"'']', '', 'g') AS clean FROM part")
def x16(spark, d):
    p = T.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), X.truncate(F.col("p_name"), 9).alias("short"), X.sanitise(F.concat(F.lit("<"), "p_name", F.lit(">"))).alias("clean"))


@query("x16_names", "SELECT p_partkey AS id, list_aggregate(list_transform(string_split(lower(replace(p_type || '_' || p_brand, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS shown, replace(replace(p_name || '; ' || p_brand || ', x', ';', ';<br>'), ', ', ',<br>') AS lines FROM part")
def x16_names(spark, d):
    p = T.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), X.display_name(F.concat_ws("_", "p_type", "p_brand")).alias("shown"), X.for_display(F.concat("p_name", F.lit("; "), "p_brand", F.lit(", x"))).alias("lines"))


@query("x17_feature_labels", """SELECT * FROM (VALUES ('risk_regime_zero_loss', 'regime', 'Zero Loss', 'risk'), ('risk_var_95', 'risk', 'Var 95', 'risk'), ('spiked_loading_1', 'spiked', 'Loading 1', 'statistical'), ('multiscale_5', 'multiscale', '5', 'statistical'),
 ('metadata_turnover', 'metadata', 'Turnover', 'metadata'), ('max_drawdown', 'other', 'Max Drawdown', 'risk'), ('mean_return', 'other', 'Mean Return', 'statistical')) t(name, family, label, kind)""")
def x17(spark, d):
    names = ["risk_regime_zero_loss", "risk_var_95", "spiked_loading_1", "multiscale_5", "metadata_turnover", "max_drawdown", "mean_return"]
    c = F.col("name")
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", X.feature_family(c).alias("family"), X.feature_label(c).alias("label"), X.feature_kind(c).alias("kind"))


@query("a1_token_usage", _U + "SELECT field, count(DISTINCT id) AS unique_count, sum(n)::BIGINT AS nominal_count FROM usage GROUP BY 1")
def a1(spark, d):
    return U.token_usage(T.usage(spark, d), "field")


@query("a3_top_tokens", _U + "SELECT field, count(DISTINCT id) AS unique_count, sum(n)::BIGINT AS nominal_count FROM usage GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def a3(spark, d):
    return U.top(U.token_usage(T.usage(spark, d), "field"), "field")


@query("a4_category_breakdown", _U + "SELECT p_type AS category, count(DISTINCT id) AS signals, count(DISTINCT field) AS fields FROM usage JOIN part ON field = p_partkey GROUP BY 1")
def a4(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("field"), F.col("p_type").alias("category"))
    return T.usage(spark, d).join(p, "field").groupBy("category").agg(F.countDistinct("id").alias("signals"), F.countDistinct("field").alias("fields"))


@query("a5_value_counts", f"WITH {T.SIGNALS_SQL} SELECT 'region' AS \"column\", region AS value, count(*) AS n FROM signals GROUP BY 2 UNION ALL SELECT 'universe', universe, count(*) FROM signals GROUP BY 2 UNION ALL SELECT 'delay', delay::VARCHAR, count(*) FROM signals GROUP BY 2")
def a5(spark, d):
    return U.value_counts(T.signals(spark, d), ["region", "universe", "delay"])


@query("a5_dates", "SELECT min(o_orderdate)::DATE::VARCHAR AS first, max(o_orderdate)::DATE::VARCHAR AS last FROM orders")
def a5_dates(spark, d):
    return U.date_range(T.table(spark, d, "orders"), "o_orderdate").select(day("first"), day("last"))


@query("a6_field_regions", _U + "SELECT count(DISTINCT (field, region)) AS n FROM usage")
def a6(spark, d):
    return T.usage(spark, d).agg(F.countDistinct("field", "region").alias("n"))


@query("a7_dataset_fields", _U + "SELECT p_brand AS dataset, list(DISTINCT field ORDER BY field)::VARCHAR AS fields FROM usage JOIN part ON field = p_partkey GROUP BY 1")
def a7(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("field"), F.col("p_brand").alias("dataset"))
    used = T.usage(spark, d).select("field").distinct().join(p, "field").groupBy("dataset").agg(F.array_sort(F.collect_set("field")).alias("f"))
    return used.select("dataset", F.concat(F.lit("["), F.array_join(F.transform("f", lambda x: x.cast("string")), ", "), F.lit("]")).alias("fields"))


@query("a8_usage_by_region", _U + "SELECT field, coalesce(region, 'all') AS region, count(DISTINCT id) AS signals FROM usage GROUP BY GROUPING SETS ((field, region), (field))")
def a8(spark, d):
    return U.usage_by_region(T.usage(spark, d), "field").where("field IS NOT NULL").select("field", F.coalesce("region", F.lit("all")).alias("region"), "signals")


@query(
    "a9_recommendations",
    _UF
    + """, available AS (SELECT u.field, f.region FROM (SELECT DISTINCT field FROM usage) u JOIN fields f USING (field)
  UNION SELECT u.field, g.region FROM (SELECT DISTINCT field FROM usage) u JOIN fields f USING (field) JOIN fields g USING (description)),
 missing AS (SELECT field, region FROM available EXCEPT SELECT field, region FROM usage)
 SELECT m.field, string_agg(m.region, ',' ORDER BY m.region) AS recommended, any_value(s.signals) AS signals FROM missing m JOIN (SELECT field, count(DISTINCT id) AS signals FROM usage GROUP BY 1) s USING (field) GROUP BY 1""",
)
def a9(spark, d):
    got = U.recommendations(T.fields(spark, d), T.usage(spark, d))
    return got.select("field", F.array_join("recommended_regions", ",").alias("recommended"), "signals")


@query("a9_details", _UF + """, own AS (SELECT field, min(description) AS description, list(DISTINCT region) AS own FROM fields GROUP BY 1), alike AS (SELECT description, region, count(DISTINCT field) AS n FROM fields GROUP BY 1, 2),
 used AS (SELECT field, list(DISTINCT region) AS regions FROM usage GROUP BY 1),
 free AS (SELECT DISTINCT field, region FROM (SELECT used.field, unnest(own) AS region FROM used JOIN own USING (field) UNION SELECT used.field, region FROM used JOIN own USING (field) JOIN alike USING (description)) EXCEPT SELECT field, region FROM usage)
 SELECT field, array_to_string(list_sort(any_value(regions)), ',') AS used_regions, string_agg(region || ':' || coalesce(n, 1), ',' ORDER BY region) AS matching FROM free JOIN used USING (field) JOIN own USING (field) LEFT JOIN alike USING (description, region) GROUP BY 1""")
def a9_details(spark, d):
    got = U.recommendations(T.fields(spark, d), T.usage(spark, d))
    return got.select("field", F.array_join("used_regions", ",").alias("used_regions"), F.array_join(F.transform("matching", lambda x: F.concat_ws(":", x["region"], x["n"].cast("string"))), ",").alias("matching"))


@query("a29_recommendation_sums", _UF + """, available AS (SELECT u.field, f.region FROM (SELECT DISTINCT field FROM usage) u JOIN fields f USING (field)
  UNION SELECT u.field, g.region FROM (SELECT DISTINCT field FROM usage) u JOIN fields f USING (field) JOIN fields g USING (description)),
 missing AS (SELECT field, region FROM available EXCEPT SELECT field, region FROM usage)
 SELECT (SELECT count(DISTINCT field) FROM usage) AS fields_analysed, count(DISTINCT field) AS opportunities, count(*) AS potential FROM missing""")
def a29(spark, d):
    used = T.usage(spark, d)
    return U.recommendation_sums(U.recommendations(T.fields(spark, d), used), used)


@query("a9b_recommendations_for_region", _UF + """, available AS (SELECT u.field FROM (SELECT DISTINCT field FROM usage) u JOIN fields f USING (field) WHERE f.region = 'ASIA' AND f.data_type = 'VECTOR'
  UNION SELECT u.field FROM (SELECT DISTINCT field FROM usage) u JOIN fields f USING (field) JOIN fields g USING (description) WHERE g.region = 'ASIA' AND g.data_type = 'VECTOR' AND f.data_type = 'VECTOR')
 SELECT field FROM available WHERE field NOT IN (SELECT field FROM usage WHERE region = 'ASIA')""")
def a9b(spark, d):
    return U.recommendations(T.fields(spark, d), T.usage(spark, d), region="ASIA", data_type="VECTOR").select("field")


@query("a10_availability", f"WITH {T.FIELDS_SQL} SELECT field, count(*) AS regions, string_agg(region || '=' || dataset, ',' ORDER BY region) AS info FROM fields GROUP BY 1")
def a10(spark, d):
    f = T.fields(spark, d).groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "dataset")))).alias("info"))
    return f.select("field", F.size("info").cast("long").alias("regions"), F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("info"))


@query("a11_tokens_of_region", _U + "SELECT DISTINCT field FROM usage WHERE region = 'ASIA'")
def a11(spark, d):
    return T.usage(spark, d).where("region = 'ASIA'").select("field").distinct()


@query("a12_first_of_group", f"WITH {T.FIELDS_SQL} SELECT field, min(region) AS region FROM fields GROUP BY 1")
def a12(spark, d):
    return store.distinct_rows(T.fields(spark, d), ["field"], [F.col("region")]).select("field", "region")


@query("a14_sizes", f"WITH {T.FIELDS_SQL} SELECT data_type, count(*) AS n FROM fields GROUP BY 1")
def a14(spark, d):
    return T.fields(spark, d).groupBy("data_type").agg(F.count("*").alias("n"))


@query("a16_usage_bands", _U + "SELECT p_partkey AS field, count(DISTINCT id) AS unique_count, CASE WHEN count(DISTINCT id) >= 10 THEN 'frequent' WHEN count(DISTINCT id) > 0 THEN 'rare' ELSE 'never' END AS band FROM part LEFT JOIN usage ON field = p_partkey GROUP BY 1")
def a16(spark, d):
    return U.usage_bands(T.table(spark, d, "part").select(F.col("p_partkey").alias("field")), T.usage(spark, d), "field")


@query("a17_dataset_statistics", _UF + """SELECT dataset, count(DISTINCT f.field) AS total_fields, count(DISTINCT u.field) AS used_fields, count(DISTINCT u.id) AS signals, round(count(DISTINCT u.field) * 100.0 / count(DISTINCT f.field), 2)::DOUBLE AS usage_percent, count(DISTINCT u.field) > 0 AS is_used
 FROM (SELECT DISTINCT field, dataset FROM fields) f LEFT JOIN (SELECT * FROM usage WHERE region = 'ASIA') u USING (field) GROUP BY 1""")
def a17(spark, d):
    return U.dataset_statistics(T.fields(spark, d), T.usage(spark, d).where("region = 'ASIA'"))


@query("a18_category_sums", _U + "SELECT p_type AS category, sum(k)::BIGINT AS n FROM (SELECT field, count(DISTINCT id) AS k FROM usage GROUP BY 1) JOIN part ON field = p_partkey GROUP BY 1")
def a18(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("field"), F.col("p_type").alias("category"))
    return U.token_ids(T.usage(spark, d), "field").join(p, "field").groupBy("category").agg(F.sum(F.size("ids")).alias("n"))


@query("a19_extremes", f"WITH {T.SIGNALS_SQL}, c AS (SELECT universe, count(*) AS n FROM signals GROUP BY 1) SELECT arg_max(universe, (n, universe)) AS most, arg_min(universe, (n, universe)) AS least FROM c")
def a19(spark, d):
    c = T.signals(spark, d).groupBy("universe").agg(F.count("*").alias("n"))
    return c.agg(F.max_by("universe", F.struct("n", "universe")).alias("most"), F.min_by("universe", F.struct("n", "universe")).alias("least"))


@query("a32_usage_summary", _U + "SELECT count(DISTINCT field) AS fields, sum(n)::BIGINT AS nominal, round(sum(n) / count(DISTINCT id), 4)::DOUBLE AS per_signal FROM usage")
def a32(spark, d):
    return T.usage(spark, d).agg(F.countDistinct("field").alias("fields"), F.sum("n").alias("nominal"), F.round(F.try_divide(F.sum("n"), F.countDistinct("id")), 4).alias("per_signal"))


@query("a28_small_categories", "SELECT CASE WHEN n < 65 THEN 'Others' ELSE c_nationkey::VARCHAR END AS nation, sum(n)::BIGINT AS n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) GROUP BY 1")
def a28(spark, d):
    return U.group_small(T.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), "nation", 65)


@query("a31_treemap", "WITH c AS (SELECT p_brand AS dataset, count(*) AS n FROM part GROUP BY 1), s AS (SELECT *, greatest(sqrt(n) * 10, 20.0) AS size FROM c), t AS (SELECT *, size / sum(size) OVER () AS part FROM s) SELECT dataset, n, round(size, 6) AS size, CASE WHEN part >= 0.015 THEN 'full' WHEN part >= 0.008 THEN 'short' WHEN part >= 0.004 THEN 'name' ELSE 'none' END AS tier, CASE WHEN n = 0 THEN 'unused' WHEN n <= 5 THEN 'low' WHEN n <= 20 THEN 'medium' ELSE 'high' END AS band FROM t")
def a31(spark, d):
    c = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("dataset")).agg(F.count("*").alias("n"))
    return U.treemap(c, "n").withColumn("size", r6("size"))


@query("a33_fields_of_region", f"WITH {T.FIELDS_SQL} SELECT DISTINCT field, region, dataset, category, data_type, description FROM fields WHERE region = 'EUROPE'")
def a33(spark, d):
    return T.fields(spark, d).where("region = 'EUROPE'").distinct()


@query("j15_matching_fields", f"WITH {T.FIELDS_SQL} SELECT DISTINCT field, description FROM fields WHERE region = 'ASIA' AND (description = (SELECT min(description) FROM fields WHERE field = 17) OR contains(field::VARCHAR, '17')) ORDER BY field LIMIT 10")
def j15(spark, d):
    return U.matching_fields(T.fields(spark, d), "17", "ASIA")
