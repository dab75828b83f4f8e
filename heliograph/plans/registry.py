"""Named queries over the star schema with, where SQL can say it, their DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero, so that values compare across engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def r6_of_many(c: Column | str, digits: int = 6) -> Column:
    """r6 of doubles, without a decimal for each: only what lies next to a half, or is large, needs one. The nearest double to an integer over a power of ten is what the decimal gives."""
    c = F.col(c) if isinstance(c, str) else c
    y = c * 10.0**digits
    return F.when((F.abs(y) < 1e9) & (F.abs(y - F.rint(y)) < 0.4999), F.rint(y) / 10.0**digits).otherwise(F.round(c, digits)) + 0.0


def day(c: str = "date") -> Column:
    """A date as text, which all engines hash alike."""
    return F.date_format(c, "yyyy-MM-dd").alias(c)
