"""Where plans are cut: the folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, as in tests, a local folder in local mode, and else an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at and context._jsc.sc().getCheckpointDir().isDefined():
        at = context._jsc.sc().getCheckpointDir().get()
    if not at:
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="heliograph-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder: rounds that follow neither repeat it nor lose it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return path


class Kept:
    """DataFrames that stay persisted for so many seconds, by name; what has expired is computed again when it is next asked for."""

    def __init__(self, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, name: str, build: Callable[[], DataFrame], seconds: float | None = None) -> DataFrame:
        found = self.held.get(name)
        if found is not None and self.clock() < found[1]:
            return found[0]
        self.drop(name)
        df = build().persist()
        self.held[name] = df, self.clock() + (self.seconds if seconds is None else seconds)
        return df

    def drop(self, name: str) -> None:
        if name in self.held:
            self.held.pop(name)[0].unpersist()

    def expire(self) -> None:
        """Gives back what has expired."""
        for name in [n for n, (_, until) in self.held.items() if self.clock() >= until]:
            self.drop(name)

    def clear(self) -> None:
        for name in list(self.held):
            self.drop(name)
