"""Incremental loads: what arrives is added to the store, and only what it touches is computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from heliograph.operators import store


def file_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", files_per_batch: int = 10) -> DataFrame:
    """A folder as a stream; each batch takes so many new files at most."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_batch).load(path)


def backfill(stream: DataFrame, at: str, checkpoint: str, keys: list[str], order: list[Column], by: str, recompute: Callable[[DataFrame, DataFrame], None] | None = None) -> StreamingQuery:
    """Appends the rows of a stream whose key the table at `at` doesn't have yet, then stops.

    recompute(table, touched) gets the whole table and the values of `by` that the batch added rows of.  A batch is
    written to a folder of its own, so that one that is run again after a failure replaces itself.
    """

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = stored(spark, at, batch.schema).where(F.col("_batch") != number)
        fresh = store.absent(store.distinct_rows(batch, keys, order), there, keys)
        fresh.write.mode("overwrite").partitionBy(by).parquet(f"{at}/_batch={number}")
        if recompute is not None:
            now = stored(spark, at, batch.schema)
            recompute(now.drop("_batch"), now.where(F.col("_batch") == number).select(by).distinct())

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, at: str, schema) -> DataFrame:
    """The table that backfill() writes, empty before its first batch; _batch, a partition column, tells which batch a row came with."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return spark.createDataFrame([], schema).withColumn("_batch", F.lit(0).cast("long"))
    whole = T.StructType([*(schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema), T.StructField("_batch", T.LongType())])
    return spark.read.schema(whole).parquet(at)


def windows_back(start: str, end: str, days: int = 7) -> list[tuple[str, str]]:
    """Windows of so many days from the newest to the oldest, whole range covered: the order in which a back-fill asks for them."""
    import datetime as dt

    first, last, out = dt.date.fromisoformat(start), dt.date.fromisoformat(end), []
    while last >= first:
        low = max(first, last - dt.timedelta(days=days - 1))
        out.append((low.isoformat(), last.isoformat()))
        last = low - dt.timedelta(days=1)
    return out


def next_end(earliest_seen: Column, end: Column, step: int = 7) -> Column:
    """End of the next window: the day before the earliest date seen, or a step back where nothing earlier was seen."""
    return F.when(earliest_seen.isNotNull() & (earliest_seen <= end), F.date_sub(earliest_seen, 1)).otherwise(F.date_sub(end, step))


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream whose key wasn't seen within the watermark."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))  # watermarks take no timestamps without a zone
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts of event types by day, batch or stream: an extension over event time."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")
