"""Risk and regime features of each series, joined on key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators import series as S
from heliograph.runtime import cut

DEFAULTS = {"mean_return": 0.0, "skewness": 0.0, "excess_kurtosis": 0.0, "sortino_ratio": 0.0, "max_drawdown": -0.1, "calmar_ratio": 0.0, "hurst_exponent": 0.5, "volatility_stability": 0.5, "tail_ratio": 1.0, "monthly_consistency": 0.5}
#: Missing values of these become the median over all keys.
MEDIANS = ["std_return", "downside_deviation", "var_95", "cvar_95"]


def gated(series: DataFrame, rows: int = 30, size: float = 1e-10) -> DataFrame:
    """Series of enough rows that aren't essentially zero."""
    ok = series.groupBy("key").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("m")).where((F.col("n") >= rows) & (F.col("m") >= size))
    return series.join(ok.select("key"), "key", "left_semi")


def sample_skewness(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def sample_kurtosis(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def moments(returns: DataFrame, least: int = 20, flat: float = 1e-10) -> DataFrame:
    """(key, mean, deviation, skewness, kurtosis, downside and tail features) of keys with enough returns that aren't constant."""
    out = returns.groupBy("key").agg(
        F.count("r").alias("n"),
        F.avg("r").alias("mean_return"),
        F.stddev_samp("r").alias("std_return"),
        F.max("r").alias("_max"),
        F.min("r").alias("_min"),
        F.percentile("r", 0.05).alias("var_95"),
        F.percentile("r", 0.95).alias("_q95"),
        F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("downside_deviation"),
    )
    out = out.where((F.col("n") >= least) & (F.col("std_return") >= flat) & (F.col("_max") > F.col("_min")))
    return out.select(
        "key",
        "n",
        "mean_return",
        "std_return",
        "downside_deviation",
        F.when(F.col("downside_deviation") > 0, F.col("mean_return") / F.col("downside_deviation") * (252**0.5)).when(F.col("downside_deviation").isNotNull(), 0.0).alias("sortino_ratio"),
        "var_95",
        F.when(F.col("var_95") != 0, F.abs("_q95") / F.abs("var_95")).otherwise(1.0).alias("tail_ratio"),
    )


def shape(returns: DataFrame) -> DataFrame:
    """(key, skewness, excess_kurtosis), corrected for the size of the sample, of keys whose returns vary."""
    many = returns.groupBy("key").agg(F.count("r").alias("n"), F.max("r").alias("hi"), F.min("r").alias("lo")).where("n > 3 AND hi > lo")
    return returns.join(many.select("key"), "key", "left_semi").groupBy("key").agg(sample_skewness("r").alias("skewness"), sample_kurtosis("r").alias("excess_kurtosis"))


def expected_shortfall(returns: DataFrame, var: DataFrame) -> DataFrame:
    """(key, cvar_95): mean of the returns that don't exceed var_95."""
    return returns.join(var.select("key", "var_95"), "key").where(F.col("r") <= F.col("var_95")).groupBy("key").agg(F.avg("r").alias("cvar_95"))


def max_drawdown(returns: DataFrame) -> DataFrame:
    d = S.drawdown(returns).groupBy("key").agg(F.min("drawdown").alias("d"), F.max("growth").alias("g"))
    return d.select("key", F.when(F.col("g") > 0, F.col("d")).otherwise(-0.01).alias("max_drawdown"))


def calmar(mean: Column, worst: Column) -> Column:
    """Annual return over the worst drawdown, within -100 and 100; 0 where there is no drawdown."""
    ratio = F.try_divide(mean * 252, F.abs(worst))
    return F.when(F.abs(worst) > 1e-10, F.greatest(F.lit(-100.0), F.least(F.lit(100.0), ratio))).otherwise(0.0)


def concentration(returns: DataFrame) -> DataFrame:
    """(key, downside_concentration): Gini coefficient of losses."""
    losses = returns.where("r < 0").select("key", F.abs("r").alias("x"))
    ranked = losses.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("x")))
    out = ranked.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("i") * F.col("x")).alias("ix"), F.sum("x").alias("x"))
    return out.select("key", (F.try_divide(2 * F.col("ix"), F.col("n") * F.col("x")) - (F.col("n") + 1) / F.col("n")).alias("downside_concentration"))


def regime(returns: DataFrame, least: int = 20) -> DataFrame:
    """(key, regime_*) of keys with enough returns."""
    s = returns.groupBy("key").agg(F.count("*").alias("n"), F.stddev_samp("r").alias("s")).where(F.col("n") >= least)
    shares = returns.join(s, "key").groupBy("key").agg(
        F.avg((F.col("r") >= 0).cast("double")).alias("regime_zero_loss_ratio"),
        F.max((F.col("r") < 0).cast("int")).alias("regime_has_downside_periods"),
        F.avg((F.col("r") == 0).cast("double")).alias("regime_constant_return_periods"),
        F.avg((F.abs("r") < F.col("s") * 0.5).cast("double")).alias("regime_low_volatility_ratio"),
    )
    runs = S.longest_run(returns, F.col("r") >= 0).withColumnRenamed("longest", "regime_max_consecutive_gains")
    losses = concentration(returns).withColumnRenamed("downside_concentration", "regime_downside_concentration")
    return shares.join(runs, "key").join(losses, "key", "left").na.fill(0.0, ["regime_downside_concentration"])


def hurst_of(r: np.ndarray, most: int = 50) -> float:
    """The exponent of one series of returns; 0.5 where fewer than two lags have a rescaled range."""
    x, y = [], []
    for lag in range(2, min(most, len(r) // 2)):
        parts = r[: len(r) // lag * lag].reshape(-1, lag)
        away = parts - parts.mean(1, keepdims=True)
        spread = np.sqrt((away * away).sum(1) / (lag - 1))
        summed = np.cumsum(away, 1)
        ok = (spread > 0) & (parts.max(1) > parts.min(1))
        if ok.any() and (mean := ((summed.max(1) - summed.min(1))[ok] / spread[ok]).mean()) > 0:
            x.append(np.log(lag))
            y.append(np.log(mean))
    if len(x) < 2:
        return 0.5
    x, y = np.array(x) - np.mean(x), np.array(y)
    return float(np.clip((x * y).sum() / (x * x).sum(), 0.0, 1.0))


def hurst(returns: DataFrame, most: int = 50) -> DataFrame:
    """(key, hurst_exponent): slope of ln(R/S) over ln(lag) for lags from 2 to min(most, n/2) - 1, within 0 and 1; 0.5 where fewer than two lags have one.

    For each lag the series is cut into whole chunks; R is the range of the summed deviations from a chunk's mean, S its sample deviation.
    Each series is one numpy pass (a series is as long as a calendar), so a return is shuffled once rather than once for each lag.
    """
    kind = returns.schema["key"].dataType.simpleString()

    def one(t: pa.Table) -> pa.Table:
        r = t["r"].to_numpy()[np.argsort(t["day"].to_numpy(), kind="stable")]
        return pa.table({"key": t["key"][:1], "hurst_exponent": pa.array([hurst_of(r, most)])})

    return returns.select("key", F.unix_date("date").alias("day"), "r").groupBy("key").applyInArrow(one, f"key {kind}, hurst_exponent double")


def risk_features(series: DataFrame) -> DataFrame:
    """One row of features for each series that passes the gates, with missing values filled by defaults or medians.

    Returns and moments are stored once: each family of features reads them. So are the features, which are read for their medians and to be filled.
    """
    returns = cut(S.relative_changes(gated(series)))
    base = cut(moments(returns))
    returns = returns.join(base.select("key"), "key", "left_semi")
    out = base.join(shape(returns), "key", "left").join(expected_shortfall(returns, base), "key", "left").join(max_drawdown(returns), "key", "left").join(hurst(returns), "key", "left")
    out = out.join(S.volatility_stability(returns).withColumnRenamed("stability", "volatility_stability"), "key", "left").join(S.monthly_consistency(returns), "key", "left")
    out = out.withColumn("volatility_stability", F.when(F.col("n") >= 40, F.col("volatility_stability")))
    out = out.withColumn("monthly_consistency", F.when((F.col("n") >= 60) & (F.col("months") > 2), F.col("consistency"))).drop("months", "consistency")
    out = out.withColumn("calmar_ratio", calmar(F.col("mean_return"), F.col("max_drawdown")))
    return cut(out.join(regime(returns), "key", "left")).transform(fill)


def fill(features: DataFrame) -> DataFrame:
    """Missing values by defaults, or by the median over all keys (one row, broadcast)."""
    medians = features.agg(*[F.median(c).alias(f"_{c}") for c in MEDIANS])
    out = features.crossJoin(F.broadcast(medians))
    for c in MEDIANS:
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out.na.fill({k: v for k, v in DEFAULTS.items() if k in features.columns})


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, nans and infinities of columns as the median of the rest."""
    for c in columns:
        df = df.withColumn(c, F.when(F.abs(F.col(c)) < float("inf"), F.col(c)))
    medians = df.agg(*[F.median(c).alias(f"_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(medians))
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_{c}"))
    return out.drop(*[f"_{c}" for c in columns])


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation; constant ones become 0."""
    stats = df.agg(*[F.avg(c).alias(f"_m{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{c}"), F.col(f"_s{c}")), F.lit(0.0)))
    return out.drop(*[f"_{x}{c}" for c in columns for x in "ms"])


def robust_scaled(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Columns less their median, over the distance of two exact quantiles (1 if that is 0)."""
    stats = df.agg(*[F.percentile(c, [0.5, low, high]).alias(f"_q{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        q = F.col(f"_q{c}")
        width = F.when(q[2] > q[1], q[2] - q[1]).otherwise(1.0)
        out = out.withColumn(c, (F.col(c) - q[0]) / width)
    return out.drop(*[f"_q{c}" for c in columns])


def clipped(df: DataFrame, columns: list[str], sigmas: float = 5.0) -> DataFrame:
    """Columns within so many sample deviations of their mean."""
    stats = df.agg(*[F.avg(c).alias(f"_m{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        lo, hi = F.col(f"_m{c}") - sigmas * F.col(f"_s{c}"), F.col(f"_m{c}") + sigmas * F.col(f"_s{c}")
        out = out.withColumn(c, F.greatest(lo, F.least(hi, F.col(c))))
    return out.drop(*[f"_{x}{c}" for c in columns for x in "ms"])


def long_form(features: DataFrame, columns: list[str]) -> DataFrame:
    """(key, feature, value), without features that are constant over all keys."""
    flat = features.unpivot("key", columns, "feature", "value")
    vary = flat.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi")
    return flat.join(F.broadcast(vary.select("feature")), "feature", "left_semi").select("key", "feature", "value")
