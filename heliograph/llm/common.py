"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, a local one in local mode, and else an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at and context._jsc.sc().getCheckpointDir().isDefined():
        at = context._jsc.sc().getCheckpointDir().get()
    if not at:
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="heliograph-")
        context.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder: later steps neither recompute nor lose them."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as a Parquet table: columnar, compressed, and prunable when read again. It is removed when the application ends."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.parquet(path)


def light_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the session's Arrow batches by bytes, `size` at most, so that batches of whole texts stay in the megabytes; one longer text is a batch of its own.

    It stays set for the session, whose plans run later. Results don't depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(2**31 - 1):  # the default: no bound; one that is set stays
        spark.conf.set(name, size)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives memory back to the system when its task ends: worker processes stay for other stages."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc
        trim(0)


#: Bits of the filter that parted() broadcasts, at most (64 MB), and of each of its rows.
FILTER_BITS, FILTER_ROW = 1 << 29, 1 << 15


def parted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be in `keys`, a stored table of one column; rows whose key surely isn't), null keys among the latter.

    Joins with the keys then move only the first, not all texts.  The filter has 64 bits for each key up to FILTER_BITS, and is
    broadcast in rows of FILTER_ROW bits; a fuller one lets more rows into the first part, whatever their number.
    """
    bits = min(max(1 << (max(keys.count(), 1) * 64 - 1).bit_length(), FILTER_ROW), FILTER_BITS)
    at, row, held = free(df, "_filter_at"), free(df, "_filter_row"), free(df, "_filter_bits")
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits).cast("long"))
    rows = keys.select(place(keys[keys.columns[0]]).alias("h")).groupBy(F.expr(f"h div {FILTER_ROW}").alias(row)).agg(F.bitmap_construct_agg(F.expr(f"h % {FILTER_ROW}")).alias(held))
    marked = df.withColumn(at, F.when(key.isNotNull(), place(key)))
    marked = marked.join(F.broadcast(rows), F.expr(f"{at} div {FILTER_ROW}") == F.col(row), "left")
    byte = F.conv(F.hex(F.expr(f"substring({held}, cast({at} % {FILTER_ROW} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.expr(f"cast({at} % 8 as int)")) == 1, F.lit(False))
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)


def free(df: DataFrame, name: str) -> str:
    """name, or with underscores before it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
