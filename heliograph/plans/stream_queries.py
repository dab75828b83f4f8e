"""Incremental loads as queries: a folder is read as a stream until nothing new is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import usage as U
from heliograph.plans.registry import day, query, r6
from heliograph.runtime import scratch
from heliograph.sources import tables as T
from heliograph.streaming import backfill as B


def _event_files(spark, d) -> str:
    """The events in a folder of several files, as they would arrive."""
    at = scratch(spark, "events")
    T.table(spark, d, "events").repartition(4, "event_id").write.parquet(at)
    return at


@query("r1_backfill", "SELECT event_id, event_type, value FROM events")
def r1(spark, d):
    events, out = _event_files(spark, d), scratch(spark, "backfill")
    schema = T.table(spark, d, "events").schema
    for _ in range(2):  # the second run finds nothing new
        stream = B.file_stream(spark, events, schema, files_per_batch=2)
        B.backfill(stream, f"{out}/table", f"{out}/checkpoint", ["event_id"], [F.col("ts")], "event_type").awaitTermination()
    return B.stored(spark, f"{out}/table", schema).select("event_id", "event_type", "value")


@query("r3_first_seen", "SELECT event_id, event_type FROM events")
def r3(spark, d):
    events, out = _event_files(spark, d), scratch(spark, "seen")
    stream = B.file_stream(spark, events, T.table(spark, d, "events").schema, files_per_batch=100)
    seen = B.first_seen(stream, ["event_id"], "ts", "40 days").select("event_id", "event_type")
    seen.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table")


@query("x_daily_usage", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS value FROM events GROUP BY 1, 2")
def daily(spark, d):
    return B.daily_usage(T.table(spark, d, "events")).withColumn("value", r6("value", 4))


@query("a30_dataset_drill_down", f"WITH {T.USAGE_SQL} SELECT field, count(DISTINCT id) AS unique_count, sum(n)::BIGINT AS nominal_count FROM usage JOIN part ON field = p_partkey WHERE p_brand = 'Brand#7' GROUP BY 1")
def a30(spark, d):
    fields = T.table(spark, d, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("field"))
    return U.token_usage(T.usage(spark, d).join(fields, "field", "left_semi"), "field")


@query("k13_share", "SELECT c_mktsegment, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM customer GROUP BY 1")
def k13_share(spark, d):
    return U.share(T.table(spark, d, "customer"), "c_mktsegment")


@query("r1_windows", "SELECT i::INT AS place, strftime(greatest(DATE '2024-01-01', DATE '2024-01-31' - INTERVAL (7 * i + 6) DAY), '%Y-%m-%d') AS low, strftime(DATE '2024-01-31' - INTERVAL (7 * i) DAY, '%Y-%m-%d') AS high FROM range(5) t(i)")
def r1_windows(spark, d):
    """The order in which a back-fill asks for January."""
    return spark.createDataFrame([(i, low, high) for i, (low, high) in enumerate(B.windows_back("2024-01-01", "2024-01-31"))], "place int, low string, high string")


@query("r1_next_end", "SELECT o_custkey AS key, CASE WHEN min(o_orderdate)::DATE <= DATE '1995-06-30' THEN min(o_orderdate)::DATE - 1 ELSE DATE '1995-06-23' END::DATE::VARCHAR AS next_end FROM orders GROUP BY 1")
def r1_next(spark, d):
    seen = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.to_date(F.min("o_orderdate")).alias("first"))
    return seen.select("key", B.next_end(F.col("first"), F.lit("1995-06-30").cast("date")).alias("next_end")).withColumn("next_end", day("next_end"))
