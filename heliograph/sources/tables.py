"""Schemas, readers and the views that instantiate the data model on star-schema tables.

One table serves all regions, partitioned by region, so that a region is a partition predicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIGNALS = """id STRING, region STRING, kind STRING, production_correlation DOUBLE, self_correlation DOUBLE, sharpe DOUBLE, fitness DOUBLE, returns DOUBLE,
drawdown DOUBLE, longs INT, shorts INT, turnover DOUBLE, margin DOUBLE, neutral_sharpe DOUBLE, neutral_fitness DOUBLE, code STRING, description STRING,
universe STRING, delay INT, neutralization STRING, decay STRING, added TIMESTAMP, updated TIMESTAMP"""
SERIES = "key STRING, date DATE, value DOUBLE, region STRING"
CORRELATIONS = "key STRING, min_correlation DOUBLE, max_correlation DOUBLE, avg_correlation DOUBLE, median_correlation DOUBLE, updated TIMESTAMP, region STRING"
BEST_MATCHES = "key STRING, max_correlation DOUBLE, best_match STRING, updated TIMESTAMP, region STRING"
PARSED = "id STRING, operators ARRAY<STRING>, operator_counts MAP<STRING,INT>, fields ARRAY<STRING>, field_counts MAP<STRING,INT>, excluded BOOLEAN, reason STRING, updated TIMESTAMP"
FIELDS = "field STRING, region STRING, dataset STRING, category STRING, data_type STRING, delay INT, description STRING"
OPERATORS = "name STRING, scope ARRAY<STRING>, category STRING"
ALL = {"signals": SIGNALS, "series": SERIES, "correlations": CORRELATIONS, "best_matches": BEST_MATCHES, "parsed": PARSED, "fields": FIELDS, "operators": OPERATORS}

#: An operator catalogue of more entries than this is taken for a broken file.
MOST_OPERATORS = 1000


def partitioned(name: str) -> bool:
    """Whether a table of ALL has a folder for each region."""
    return ALL[name].endswith("region STRING") or ", region STRING," in ALL[name].replace("\n", " ")


def initialise(spark: SparkSession, path: str) -> dict[str, str]:
    """Creates every table that isn't there yet, empty, with its schema beside it; running it again changes nothing.

    Tables with a region are written with partitionBy("region") from then on, and read by stored(); an empty one has no partition yet.
    """
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for name, schema in ALL.items():
        at = f"{path}/{name}"
        target = jvm.org.apache.hadoop.fs.Path(at)
        if not target.getFileSystem(conf).exists(target):
            append(spark.createDataFrame([], schema), at, name)
        out[name] = at
    return out


def append(df: DataFrame, at: str, name: str) -> None:
    """Adds rows to a table, in the folders of their regions where it has them."""
    writer = conform(df, ALL[name]).write.mode("append")
    (writer.partitionBy("region") if partitioned(name) else writer).parquet(at)


def stored(spark: SparkSession, at: str, name: str) -> DataFrame:
    """A table of ALL; regions are partitions, so a region is pruned to its folder."""
    return conform(spark.read.schema(ALL[name]).parquet(at), ALL[name])


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of a schema: missing ones null, extra ones dropped, others cast (an additive migration)."""
    want = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def read_operators(spark: SparkSession, path: str) -> DataFrame:
    """(name, scope, category) of an operator catalogue: JSON - a list, or an object with a list `operators` - or comma-separated text."""
    if path.endswith(".txt"):
        names = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", ",")).alias("name"))
        out = names.select(F.btrim("name", F.lit(" \t\r\n")).alias("name"), F.lit(None).cast("array<string>").alias("scope"), F.lit(None).cast("string").alias("category")).where("name != ''")
    else:
        raw = spark.read.json(path, multiLine=True)
        if "operators" in raw.columns:
            raw = raw.select(F.explode("operators").alias("o")).select("o.*")
        out = conform(raw, OPERATORS)
    if out.limit(MOST_OPERATORS + 1).count() > MOST_OPERATORS:
        raise ValueError(f"{path} has more than {MOST_OPERATORS} operators")
    return out


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; all columns are strings unless a schema says otherwise."""
    return spark.read.csv(path, header=True, schema=schema)


def latest_file(spark: SparkSession, path: str, by: str) -> DataFrame:
    """Of JSON documents, the rows of the newest file for each value of `by`."""
    raw = spark.read.json(path, multiLine=True).withColumn("_at", F.col("_metadata.file_modification_time")).withColumn("_from", F.col("_metadata.file_path"))
    newest = raw.groupBy(by).agg(F.max_by("_from", F.struct("_at", "_from")).alias("_newest"))
    return raw.join(newest, by).where("_from = _newest").drop("_at", "_from", "_newest")


def flatten_records(raw: DataFrame) -> DataFrame:
    """Nested records (id, type, settings, regular, is) as flat rows; those without an id or a region are rejected."""
    flat = raw.select(
        "id",
        F.col("settings.region").alias("region"),
        F.col("type").alias("kind"),
        F.col("is.sharpe").cast("double").alias("sharpe"),
        F.col("is.fitness").cast("double").alias("fitness"),
        F.col("is.riskNeutralized.sharpe").cast("double").alias("neutral_sharpe"),
        F.col("regular.code").alias("code"),
        F.col("settings.universe").alias("universe"),
        F.col("settings.delay").cast("int").alias("delay"),
    )
    return flat.where("id IS NOT NULL AND region IS NOT NULL")


def flatten_recordset(raw: DataFrame, key: str = "key") -> DataFrame:
    """(key, date, value) of recordsets `records` (arrays of strings): the first entry is the date, the second the value, whatever else follows."""
    rows = raw.select(key, F.explode("records").alias("r"))
    return rows.select(key, F.expr("try_cast(try_element_at(r, 1) AS DATE)").alias("date"), F.expr("try_cast(try_element_at(r, 2) AS DOUBLE)").alias("value")).where("date IS NOT NULL AND value IS NOT NULL")


def best_value_column(df: DataFrame, key: str, date: str, first: str, second: str) -> DataFrame:
    """(key, date, value): of two value columns, for each key the one that rose more from the first to the last date (the first on a tie)."""
    rise = lambda c: F.max_by(c, date) - F.min_by(c, date)
    pick = df.groupBy(key).agg((F.coalesce(rise(second), F.lit(0.0)) > F.coalesce(rise(first), F.lit(0.0))).alias("_second"))
    return df.join(pick, key).select(key, date, F.when(F.col("_second"), F.col(second)).otherwise(F.col(first)).alias("value"))


# --- the data model on the star schema ---

#: Rows of a partition of spread().
ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows of a file in partitions by columns, of about ROWS rows each at every size: what is grouped by these columns needs no other shuffle, and a task's memory doesn't grow with a split."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS)), *by)  # counted from the footers


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier: id, name, region, universe, kind, delay, score."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    nations = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    kind = F.when(F.col("s_suppkey") % 5 == 0, "SUPER").when(F.col("s_suppkey") % 2 == 0, "REGULAR").otherwise("UNSUBMITTED")
    return s.join(F.broadcast(nations), s.s_nationkey == nations.n_nationkey).select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("r_name").alias("region"), F.col("n_name").alias("universe"), kind.alias("kind"), (F.col("s_suppkey") % 3).cast("int").alias("delay"), F.col("s_acctbal").alias("score")
    )


def daily_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, date, change): what each supplier's series gains on a day, to the four digits that such products have, whatever the order of the sum."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)), 4).alias("change"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, date, value): each supplier's cumulative series."""
    w = Window.partitionBy("key").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily_changes(spark, sf_dir).select("key", "date", F.sum("change").over(w).alias("value"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field catalogue: each part in the regions where it is offered (all but one in three)."""
    p, r = table(spark, sf_dir, "part"), table(spark, sf_dir, "region")
    return p.crossJoin(F.broadcast(r)).where((F.col("p_partkey") + F.col("r_regionkey")) % 3 != 0).select(
        F.col("p_partkey").alias("field"), F.col("r_name").alias("region"), F.col("p_brand").alias("dataset"), F.col("p_type").alias("category"),
        F.element_at(F.array(F.lit("MATRIX"), F.lit("VECTOR"), F.lit("GROUP")), (F.col("p_size") % 3 + 1).cast("int")).alias("data_type"), F.col("p_name").alias("description"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, field, n, region): how often each signal uses each field, and the signal's region."""
    lines = spread(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("field")), "id", "field")
    used = lines.groupBy("id", "field").agg(F.count("*").alias("n"))
    return used.join(F.broadcast(signals(spark, sf_dir).select("id", "region")), "id").select("id", "field", "n", "region")


#: The same views in SQL, to put after WITH.
SIGNALS_SQL = """signals AS (SELECT s_suppkey AS id, s_name AS name, r_name AS region, n_name AS universe,
  CASE WHEN s_suppkey % 5 = 0 THEN 'SUPER' WHEN s_suppkey % 2 = 0 THEN 'REGULAR' ELSE 'UNSUBMITTED' END AS kind, (s_suppkey % 3)::INT AS delay, s_acctbal AS score
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SERIES_SQL = """changes AS (SELECT l_suppkey AS key, l_shipdate::DATE AS date, round(sum(l_extendedprice * (l_discount - 0.05)), 4) AS change FROM lineitem GROUP BY 1, 2),
series AS (SELECT key, date, sum(change) OVER (PARTITION BY key ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM changes)"""
FIELDS_SQL = """fields AS (SELECT p_partkey AS field, r_name AS region, p_brand AS dataset, p_type AS category, ['MATRIX', 'VECTOR', 'GROUP'][p_size % 3 + 1] AS data_type, p_name AS description
  FROM part, region WHERE (p_partkey + r_regionkey) % 3 != 0)"""
USAGE_SQL = SIGNALS_SQL + """,
usage AS (SELECT l_suppkey AS id, l_partkey AS field, count(*) AS n, any_value(signals.region) AS region FROM lineitem JOIN signals ON l_suppkey = signals.id GROUP BY 1, 2)"""
