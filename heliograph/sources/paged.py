"""A Python data source for paged services: one input partition for each page, fetched in parallel by the executors.

The engine knows no service; a fetch function (offset, limit) -> list of records is given by its import path, does its own
authentication, and is retried with growing waits.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from heliograph.runtime import scratch


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.total, self.limit = options["fetch"], int(options["total"]), int(options.get("limit", 100))
        self.offset = int(options.get("offset", 0))
        self.retries, self.wait, self.pause = int(options.get("retries", 3)), float(options.get("wait", 1.0)), float(options.get("pause", 0.0))

    def partitions(self) -> list[Page]:
        return [Page(self.offset + at, min(self.limit, self.total - at)) for at in range(0, self.total, self.limit)]

    def read(self, partition: Page) -> Iterator[tuple]:
        module, _, name = self.fetch.rpartition(".")
        fetch = getattr(importlib.import_module(module), name)
        time.sleep(self.pause)
        for turn in range(self.retries + 1):
            try:
                found = fetch(partition.offset, partition.limit)
                break
            except Exception:
                if turn == self.retries:
                    raise
                time.sleep(self.wait * 2**turn)
        for x in found:
            yield (partition.offset, json.dumps(x))


class PagedSource(DataSource):
    """Options: fetch (import path), total (records, from a probe), limit (records of a page), offset (of the first), retries, wait (seconds
    before the first retry, doubled each time), pause (seconds before each page: with so many tasks at once, so many pages in that time at most)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page long, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, fetch: str, total: int, **options) -> DataFrame:
    """(page, record): records of a paged service as JSON, with the offset of their page."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").option("fetch", fetch).option("total", total)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_paged(spark: SparkSession, fetch: str, total: int, schema: str, **options) -> DataFrame:
    """Records of a paged service as rows of a schema."""
    return read_pages(spark, fetch, total, **options).select(F.from_json("record", schema).alias("r")).select("r.*")


class Ramp:
    """How many pages to ask for at once where their number isn't known: `first`, then more each time up to `most`, until over `empty` of them have nothing."""

    def __init__(self, first: int = 10, step: int = 5, most: int = 20, empty: float = 0.8):
        self.pages, self.step, self.most, self.empty = first, step, most, empty

    def seen(self, asked: int, without: int) -> bool:
        """Notes an answer; whether to go on."""
        self.pages = min(self.pages + self.step, self.most)
        return without <= asked * self.empty


def read_until_empty(spark: SparkSession, fetch: str, schema: str, limit: int = 100, ramp: Ramp | None = None, **options) -> DataFrame:
    """Records of a paged service that doesn't tell how many it has: pages are fetched by the executors, some at once, into the shared folder."""
    ramp, offset, at = ramp or Ramp(), 0, scratch(spark, "pages")
    while True:
        asked = ramp.pages
        read_pages(spark, fetch, (asked * limit), limit=limit, offset=offset, **options).write.mode("append").parquet(at)
        held = spark.read.parquet(at).where(F.col("page") >= offset).select("page").distinct().count()
        offset += asked * limit
        if not ramp.seen(asked, asked - held):
            return spark.read.parquet(at).select(F.from_json("record", schema).alias("r")).select("r.*")


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of named lists of parameters, one row each."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        out = axis if out is None else out.crossJoin(axis)
    return out
