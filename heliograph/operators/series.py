"""Ordered-series operators over (key, date, value), as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Capital that cumulative values come on top of.
CAPITAL = 1e7


def by_date(key: str = "key", date: str = "date"):
    return Window.partitionBy(key).orderBy(date)


def _all(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def change(value: Column, w) -> Column:
    """What a cumulative series gains; its first level counts as gained."""
    return value - F.coalesce(F.lag(value).over(w), F.lit(0.0))


def capital_return(value: Column, w, capital: float = CAPITAL) -> Column:
    """Gain over what was held before. Capital and running sum telescope to capital + value, so no sum is taken."""
    before = F.lag(value).over(w)
    return F.try_divide(value - before, before + capital)


def relative_changes(series: DataFrame) -> DataFrame:
    """(key, date, r): relative change of the last known value; the first, undefined and infinite ones are left out."""
    w = by_date()
    filled = F.coalesce(F.last("value", ignorenulls=True).over(_all(w)), F.lit(0.0))
    base = series.select("key", "date", filled.alias("value"))
    before = F.lag("value").over(w)
    return base.select("key", "date", F.try_divide(F.col("value") - before, before).alias("r")).where("r IS NOT NULL AND NOT isnan(r) AND abs(r) != double('Infinity')")


def tail(series: DataFrame, n: int = 400) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("date"))
    return series.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n).drop("_back")


def calendar_tail(series: DataFrame, years: int = 4, least: int = 60) -> DataFrame:
    """The last so many years of each key, or all of it where fewer than `least` rows would remain."""
    w = Window.partitionBy("key")
    start = F.add_months(F.max("date").over(w), -12 * years)
    marked = series.withColumn("_in", (F.col("date") >= start).cast("int"))
    return marked.withColumn("_n", F.sum("_in").over(w)).where((F.col("_in") == 1) | (F.col("_n") < least)).drop("_in", "_n")


def drawdown(returns: DataFrame) -> DataFrame:
    """(key, date, growth, drawdown): product of 1 + r, and how far it is under its running maximum."""
    w = _all(by_date())
    grown = returns.withColumn("growth", F.product(1 + F.col("r")).over(w)).withColumn("_peak", F.max("growth").over(w))
    peak = F.when(F.col("_peak") == 0, 1e-10).otherwise(F.col("_peak"))
    return grown.select("key", "date", "growth", ((F.col("growth") - peak) / peak).alias("drawdown"))


def simple_drawdown(series: DataFrame) -> DataFrame:
    """(key, drawdown): the deepest fall of a cumulative series under its peak, relative to that peak."""
    peak = F.max("value").over(_all(by_date()))
    fall = series.select("key", F.try_divide(F.col("value") - peak, peak + 1e-8).alias("d"))
    return fall.groupBy("key").agg(F.min("d").alias("drawdown"))


def volatility_stability(returns: DataFrame, width: int = 20) -> DataFrame:
    """(key, stability): 1 / (1 + deviation of the rolling deviation); only full windows count."""
    w = by_date().rowsBetween(-(width - 1), 0)
    rolling = returns.select("key", F.when(F.count("r").over(w) == width, F.stddev_samp("r").over(w)).alias("s"))
    out = rolling.groupBy("key").agg(F.stddev_samp("s").alias("d"))
    return out.select("key", F.when(F.col("d") > 0, 1 / (1 + F.col("d"))).otherwise(1.0).alias("stability"))


def longest_run(returns: DataFrame, condition: Column) -> DataFrame:
    """(key, longest): rows of the longest run that meets a condition (gaps and islands)."""
    w = by_date()
    marked = returns.select("key", "date", condition.alias("ok"))
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("key", "ok").orderBy("date"))
    runs = marked.withColumn("island", island).groupBy("key", "ok", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("longest"))


def monthly_consistency(returns: DataFrame) -> DataFrame:
    """(key, months, consistency): months, and the share of them with a positive sum."""
    months = returns.groupBy("key", F.trunc("date", "month").alias("month")).agg(F.sum("r").alias("r"))
    return months.groupBy("key").agg(F.count("*").alias("months"), F.avg((F.col("r") > 0).cast("double")).alias("consistency"))


def decay_weights(series: DataFrame, half_life: float = 60.0) -> DataFrame:
    """series with a weight that halves every half_life rows back from the last."""
    w = Window.partitionBy("key").orderBy(F.desc("date"))
    return series.withColumn("weight", F.exp(-F.log(F.lit(2.0)) / half_life * (F.row_number().over(w) - 1)))


def common_calendar(series: DataFrame) -> DataFrame:
    """(date): dates that all keys have."""
    n = series.agg(F.countDistinct("key").alias("_n"))
    return series.groupBy("date").agg(F.countDistinct("key").alias("n")).crossJoin(F.broadcast(n)).where("n = _n").select("date")


def moving_windows(calendar: DataFrame, width: int = 120) -> DataFrame:
    """(window, date): overlapping windows of a calendar of n dates, stepped by a tenth of it; a date is in several."""
    ranked = calendar.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("at"))
    size = ranked.agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 10)).cast("int")
    starts = size.where(F.col("n") >= width).select(F.explode(F.sequence(F.lit(0), (F.col("n") - width).cast("int"), step)).alias("window"))
    return ranked.join(F.broadcast(starts), (F.col("at") >= F.col("window")) & (F.col("at") < F.col("window") + width)).select("window", "date")
