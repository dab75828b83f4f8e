"""Queries over ordered series: windows, pairwise correlation, features of risk and regime."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from heliograph.operators import correlation as C
from heliograph.operators import features as X
from heliograph.operators import gathered as B
from heliograph.operators import graph as G
from heliograph.operators import series as S
from heliograph.plans.registry import day, query, r6, r6_of_many
from heliograph.sources import tables as T

_W = f"WITH {T.SERIES_SQL} "
_CAPITAL_SQL = f"{T.SERIES_SQL}, capital AS (SELECT key, date, value + 1e7 AS value FROM series), gains AS (SELECT key, date, (value - lag(value) OVER w) / lag(value) OVER w AS r FROM capital WINDOW w AS (PARTITION BY key ORDER BY date)), returns AS (SELECT * FROM gains WHERE r IS NOT NULL)"
_R = f"WITH {_CAPITAL_SQL} "


def _pairs_sql(a: str = "series", b: str = "series", on: str = "a.key < b.key") -> str:
    return f"""met AS (SELECT a.key AS a, b.key AS b, a.date, a.value AS x, b.value AS y FROM {a} a JOIN {b} b ON a.date = b.date AND {on}),
met_returns AS (SELECT a, b, date, (x - lag(x) OVER w) / nullif(lag(x) OVER w + 1e7, 0) AS r, (y - lag(y) OVER w) / nullif(lag(y) OVER w + 1e7, 0) AS s FROM met WINDOW w AS (PARTITION BY a, b ORDER BY date)),
pairs AS (SELECT a, b, count(r * s) AS n, corr(r, s) AS corr FROM met_returns GROUP BY 1, 2 HAVING count(*) >= 20 AND count(r * s) >= 20)"""


_P = f"WITH RECURSIVE {T.SERIES_SQL}, {_pairs_sql()}"
_MIRRORED = "mirrored AS (SELECT a AS key, b AS partner, corr FROM pairs UNION ALL SELECT b, a, corr FROM pairs)"
_SUMMARY = f"{_MIRRORED}, summary AS (SELECT key, min(corr) AS lo, max(corr) AS hi, avg(corr) AS mean, median(corr) AS mid FROM mirrored GROUP BY 1)"
#: Correlation from which two series of the test tables count as alike; theirs are weaker than those of real signals.
ALIKE = 0.15
_EDGES = f"edges AS (SELECT a, b, corr FROM pairs WHERE abs(corr) >= {ALIKE})"


def _capital(spark, d):
    """(key, date, value): what is held, capital and gains."""
    return T.series(spark, d).withColumn("value", F.col("value") + S.CAPITAL)


def _returns(spark, d):
    return S.relative_changes(_capital(spark, d))


def _event_series(spark, d):
    """(key, date, value): the few series of a shared calendar, by event type."""
    return T.table(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("value"))


_EVENTS_SQL = "event_series AS (SELECT event_type AS key, ts::DATE AS date, sum(value) AS value FROM events GROUP BY 1, 2)"

# --- windows ---


@query("w1_daily_change", _W + "SELECT key, date::VARCHAR AS date, round(value - coalesce(lag(value) OVER (PARTITION BY key ORDER BY date), 0), 4) + 0.0 AS change FROM series")
def w1(spark, d):
    return T.series(spark, d).select("key", day(), r6(S.change(F.col("value"), S.by_date()), 4).alias("change"))


@query("w3_capital_return", _W + "SELECT key, date::VARCHAR AS date, round((value - lag(value) OVER w) / (lag(value) OVER w + 1e7), 9) + 0.0 AS r FROM series WINDOW w AS (PARTITION BY key ORDER BY date)")
def w3(spark, d):
    return T.series(spark, d).select("key", day(), r6(S.capital_return(F.col("value"), S.by_date()), 9).alias("r"))


@query("w5_relative_change", _R + "SELECT key, date::VARCHAR AS date, round(r, 9) + 0.0 AS r FROM returns")
def w5(spark, d):
    return _returns(spark, d).select("key", day(), r6("r", 9).alias("r"))


@query("w6_tail", _W + "SELECT key, date::VARCHAR AS date FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date DESC) AS k FROM series) WHERE k <= 400")
def w6(spark, d):
    return S.tail(T.series(spark, d)).select("key", day())


@query("w7_calendar_tail", _W + ", m AS (SELECT key, date, (date >= max(date) OVER (PARTITION BY key) - INTERVAL 48 MONTH)::INT AS i FROM series) SELECT key, count(*) AS n, min(date)::DATE::VARCHAR AS first FROM (SELECT *, sum(i) OVER (PARTITION BY key) AS n FROM m) WHERE i = 1 OR n < 60 GROUP BY 1")
def w7(spark, d):
    return S.calendar_tail(T.series(spark, d)).groupBy("key").agg(F.count("*").alias("n"), F.min("date").alias("first")).select("key", "n", day("first"))


_DRAWDOWN = "grown AS (SELECT key, date, product(1 + r) OVER (PARTITION BY key ORDER BY date) AS growth FROM returns), fallen AS (SELECT key, date, growth, growth / max(growth) OVER (PARTITION BY key ORDER BY date) - 1 AS drawdown FROM grown)"


@query("w8_drawdown", f"{_R}, {_DRAWDOWN} SELECT key, date::VARCHAR AS date, round(growth, 6) + 0.0 AS growth, round(drawdown, 6) + 0.0 AS drawdown FROM fallen")
def w8(spark, d):
    return S.drawdown(_returns(spark, d)).select("key", day(), r6("growth").alias("growth"), r6("drawdown").alias("drawdown"))


@query("w9_simple_drawdown", f"WITH {_CAPITAL_SQL} SELECT key, round(min((value - peak) / (peak + 1e-8)), 6) + 0.0 AS drawdown FROM (SELECT *, max(value) OVER (PARTITION BY key ORDER BY date) AS peak FROM capital) GROUP BY 1")
def w9(spark, d):
    return S.simple_drawdown(_capital(spark, d)).withColumn("drawdown", r6("drawdown"))


@query("w10_volatility_stability", _R + ", rolling AS (SELECT key, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS s FROM returns WINDOW w AS (PARTITION BY key ORDER BY date ROWS 19 PRECEDING)) SELECT key, round(CASE WHEN stddev_samp(s) > 0 THEN 1 / (1 + stddev_samp(s)) ELSE 1 END, 9) + 0.0 AS stability FROM rolling GROUP BY 1")
def w10(spark, d):
    return S.volatility_stability(_returns(spark, d)).withColumn("stability", r6("stability", 9))


_ISLANDS = "islands AS (SELECT key, r >= 0 AS ok, row_number() OVER (PARTITION BY key ORDER BY date) - row_number() OVER (PARTITION BY key, r >= 0 ORDER BY date) AS island FROM returns), runs AS (SELECT key, ok, island, count(*) AS n FROM islands GROUP BY 1, 2, 3)"


@query("w11_longest_run", f"{_R}, {_ISLANDS} SELECT key, coalesce(max(n) FILTER (ok), 0) AS longest FROM runs GROUP BY 1")
def w11(spark, d):
    return S.longest_run(_returns(spark, d), F.col("r") >= 0)


@query("w12_monthly_consistency", _R + ", months AS (SELECT key, date_trunc('month', date) AS month, sum(r) AS r FROM returns GROUP BY 1, 2) SELECT key, count(*) AS months, round(avg((r > 0)::INT), 6) + 0.0 AS consistency FROM months GROUP BY 1")
def w12(spark, d):
    return S.monthly_consistency(_returns(spark, d)).withColumn("consistency", r6("consistency"))


@query("w13_decay_weights", _W + "SELECT key, date::VARCHAR AS date, round(exp(-ln(2) / 60 * (row_number() OVER (PARTITION BY key ORDER BY date DESC) - 1)), 9) + 0.0 AS weight FROM series")
def w13(spark, d):
    return S.decay_weights(T.series(spark, d)).select("key", day(), r6("weight", 9).alias("weight"))


def _rolling_sql() -> str:
    widths, out = (60, 120, 252), []
    total = sum(1 / (i + 1) for i in range(len(widths)))
    for i, n in enumerate(widths):
        out.append(f"CASE WHEN count(*) OVER w{i} >= {max(30, n - 1)} THEN corr(r, s) OVER w{i} END AS c{i}")
    over = ", ".join(f"w{i} AS (PARTITION BY a, b ORDER BY date ROWS {n - 2} PRECEDING)" for i, n in enumerate(widths))
    mean = " + ".join(f"coalesce(median(c{i}), 0) * {1 / (i + 1) / total!r}" for i in range(len(widths)))
    return f"SELECT a, b, round({mean}, 6) + 0.0 AS corr FROM (SELECT a, b, {', '.join(out)} FROM (SELECT * FROM met_returns WHERE r IS NOT NULL AND s IS NOT NULL) WINDOW {over}) GROUP BY 1, 2"


@query("w14_rolling_correlation", f"WITH {T.SERIES_SQL}, {_pairs_sql()} {_rolling_sql()}")
def w14(spark, d):
    return C.rolling(T.series(spark, d)).withColumn("corr", r6_of_many("corr"))


@query("w15_moving_windows", f"WITH {_EVENTS_SQL}, ranked AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n FROM (SELECT date FROM event_series GROUP BY 1 HAVING count(DISTINCT key) = (SELECT count(DISTINCT key) FROM event_series))), starts AS (SELECT unnest(range(0, max(n) - 9, greatest(1, max(n) // 10)))::INT AS win FROM ranked) SELECT win AS \"window\", date::VARCHAR AS date FROM ranked, starts WHERE place >= win AND place < win + 10")
def w15(spark, d):
    return S.moving_windows(S.common_calendar(_event_series(spark, d)), 10).select("window", day())


@query("w15_moving_windows_default", f"WITH {_EVENTS_SQL}, ranked AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n FROM (SELECT date FROM event_series GROUP BY 1 HAVING count(DISTINCT key) = (SELECT count(DISTINCT key) FROM event_series))), starts AS (SELECT unnest(range(0, max(n) - 119, greatest(1, max(n) // 10)))::INT AS win FROM ranked) SELECT win AS \"window\", date::VARCHAR AS date FROM ranked, starts WHERE place >= win AND place < win + 120")
def w15_default(spark, d):
    return S.moving_windows(S.common_calendar(_event_series(spark, d))).select("window", day())


@query("u3_common_calendar", f"WITH {_EVENTS_SQL} SELECT date::VARCHAR AS date FROM event_series GROUP BY 1 HAVING count(DISTINCT key) = (SELECT count(DISTINCT key) FROM event_series)")
def u3(spark, d):
    return S.common_calendar(_event_series(spark, d)).select(day())


# --- pairs ---


@query(
    "a21_correlation_summary",
    f"{_P}, {_SUMMARY}, {T.SIGNALS_SQL} SELECT id, region, round(lo, 6) + 0.0 AS min_correlation, round(hi, 6) + 0.0 AS max_correlation, round(mean, 6) + 0.0 AS avg_correlation, round(mid, 6) + 0.0 AS median_correlation FROM summary JOIN signals ON id = key",
)
def a21(spark, d):
    """Flagship: how each signal's returns go with those of all others, with its region, least correlated first."""
    found = B.summary(T.series(spark, d)).withColumnRenamed("key", "id")
    rounded = [r6(c).alias(c) for c in ("min_correlation", "max_correlation", "avg_correlation", "median_correlation")]
    return T.signals(spark, d).select("id", "region").join(found, "id").select("id", "region", *rounded).orderBy(F.asc_nulls_last("avg_correlation"), "id")


@query("m1_pair_correlation", f"{_P} SELECT a, b, n, round(corr, 6) + 0.0 AS corr FROM pairs")
def m1(spark, d):
    return C.correlate(T.series(spark, d)).withColumn("corr", r6_of_many("corr"))


@query("m1_pair_correlation_by_join", f"{_P} SELECT a, b, n, round(corr, 6) + 0.0 AS corr FROM pairs")
def m1_join(spark, d):
    return C.pairs_by_join(T.series(spark, d), joined=C.JOINED).withColumn("corr", r6_of_many("corr"))


@query("m3_correlation_of_tails", f"WITH {T.SERIES_SQL}, tails AS (SELECT key, date, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date DESC) AS k FROM series) WHERE k <= 400), {_pairs_sql('tails', 'tails').replace('count(*) >= 20', 'count(*) >= 60')} SELECT a, b, n, round(corr, 6) + 0.0 AS corr FROM pairs")
def m3(spark, d):
    return C.correlate(S.tail(T.series(spark, d)), least=60).withColumn("corr", r6_of_many("corr"))


@query(
    "a22_best_match",
    f"WITH {T.SERIES_SQL}, fresh AS (SELECT * FROM series WHERE key % 2 = 1), old AS (SELECT * FROM series WHERE key % 2 = 0), {_pairs_sql('fresh', 'old', 'true')} SELECT a AS key, round(max(abs(corr)), 6) + 0.0 AS max_correlation, arg_min(b, (-abs(corr), b)) AS best_match FROM pairs WHERE corr IS NOT NULL GROUP BY 1",
)
def a22(spark, d):
    s = T.series(spark, d)
    return B.best_match(s.where("key % 2 = 1"), s.where("key % 2 = 0")).withColumn("max_correlation", r6("max_correlation"))


@query("a23_positive_max", f"{_P}, {_MIRRORED} SELECT key, round(greatest(max(corr), 0), 6) + 0.0 AS correlation FROM mirrored GROUP BY 1")
def a23(spark, d):
    return B.positive_max(T.series(spark, d)).withColumn("correlation", r6("correlation"))


@query("j10_reference_correlation", f"WITH {T.SERIES_SQL}, others AS (SELECT * FROM series WHERE key != 1), ref AS (SELECT * FROM series WHERE key = 1), {_pairs_sql('others', 'ref', 'true')} SELECT a AS key, round(corr, 6) + 0.0 AS correlation FROM pairs WHERE corr IS NOT NULL")
def j10(spark, d):
    return C.with_reference(T.series(spark, d), 1, positive=False).withColumn("correlation", r6("correlation"))


@query("m4_noise_threshold", f"{_P}, t AS (SELECT least(0.95, 0.5 * sqrt(ln(count(*)) / floor(avg(n)))) AS threshold FROM (SELECT key, count(*) AS n FROM series GROUP BY 1)) SELECT a, b, round(CASE WHEN abs(corr) > threshold THEN corr ELSE 0 END, 6) + 0.0 AS corr FROM pairs, t")
def m4(spark, d):
    s = T.series(spark, d)
    return C.thresholded(C.correlate(s), C.noise_threshold(s, 0.5)).select("a", "b", r6_of_many("corr").alias("corr"))


@query("m4_noise_threshold_default", f"{_P}, t AS (SELECT least(0.95, 2.5 * sqrt(ln(count(*)) / floor(avg(n)))) AS threshold FROM (SELECT key, count(*) AS n FROM series GROUP BY 1)) SELECT a, b, round(CASE WHEN abs(corr) > threshold THEN corr ELSE 0 END, 6) + 0.0 AS corr FROM pairs, t")
def m4_default(spark, d):
    s = T.series(spark, d)
    return C.thresholded(C.correlate(s), C.noise_threshold(s)).select("a", "b", r6_of_many("corr").alias("corr"))


@query("p12_network_edges_default", f"{_P} SELECT a, b, round(corr, 6) + 0.0 AS corr FROM pairs WHERE abs(corr) >= 0.3")
def p12_default(spark, d):
    return B.edges(T.series(spark, d), 0.3).withColumn("corr", r6_of_many("corr"))


@query("m6_distances", f"{_P} SELECT a, b, round(sqrt(2 * (1 - corr * 0.9)), 6) AS euclidean, round(sqrt((1 - corr * 0.9) / 2), 6) AS angular, round(1 - corr * 0.9, 6) AS simple FROM pairs")
def m6(spark, d):
    p = C.shrunk(C.correlate(T.series(spark, d)))
    return p.select("a", "b", *[r6_of_many(C.distance(F.col("corr"), k)).alias(k) for k in ("euclidean", "angular", "simple")])


# --- graphs ---


def _edges(spark, d):
    return B.edges(T.series(spark, d), ALIKE)


@query("p12_network_edges", f"{_P}, {_EDGES} SELECT a, b, round(corr, 6) + 0.0 AS corr FROM edges")
def p12(spark, d):
    return _edges(spark, d).withColumn("corr", r6_of_many("corr"))


@query("m31_degrees", f"{_P}, {_EDGES}, deg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1) SELECT id, degree, degree > avg(degree) OVER () AS hub FROM deg")
def m31_degrees(spark, d):
    return G.with_hubs(B.degrees(T.series(spark, d), ALIKE))


@query("m31_density", f"{_P}, {_EDGES} SELECT (SELECT count(*) FROM supplier) AS nodes, count(*) AS edges, round(2.0 * count(*) / ((SELECT count(*) FROM supplier) * ((SELECT count(*) FROM supplier) - 1)), 9)::DOUBLE AS density FROM edges")
def m31_density(spark, d):
    ends = B.degrees(T.series(spark, d), ALIKE).agg((F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("edges"))
    return G.density(ends, T.table(spark, d, "supplier")).withColumn("density", r6("density", 9))


@query("m31_components", f"{_P}, {_EDGES}, links AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges), reach(id, root) AS (SELECT DISTINCT x, x FROM links UNION SELECT y, root FROM reach JOIN links ON id = x) SELECT id, min(root) AS root FROM reach GROUP BY 1")
def m31_components(spark, d):
    return B.components(T.series(spark, d), ALIKE)


@query(
    "m30_spanning_tree",
    f"""{_P}, e AS (SELECT a, b, round(sqrt(2 * (1 - corr)), 9) AS w FROM pairs),
prim(step, nodes, a, b, w) AS (SELECT 0, [(SELECT min(a) FROM e)], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE
  UNION ALL SELECT step + 1, list_append(nodes, CASE WHEN list_contains(nodes, a) THEN b ELSE a END), a, b, w FROM (
    SELECT p.step, p.nodes, e.a, e.b, e.w, row_number() OVER (ORDER BY e.w, e.a, e.b) AS k FROM prim p, e WHERE list_contains(p.nodes, e.a) != list_contains(p.nodes, e.b)) WHERE k = 1)
SELECT a, b, round(w, 6) AS distance FROM prim WHERE step > 0""",
)
def m30(spark, d):
    tree = B.minimum_spanning_tree(T.series(spark, d), lambda corr: np.round(np.sqrt(2 * (1 - corr)), 9))
    return tree.withColumn("distance", F.round("distance", 6))


# --- features ---


@query("m7_shape", _R + "SELECT key, round(skewness(r), 6) + 0.0 AS skewness, round(kurtosis(r), 6) + 0.0 AS excess_kurtosis FROM returns GROUP BY 1 HAVING count(*) > 3")
def m7(spark, d):
    return X.shape(_returns(spark, d)).select("key", r6("skewness").alias("skewness"), r6("excess_kurtosis").alias("excess_kurtosis"))


_MOMENTS = "SELECT key, count(*) AS n, avg(r) AS mean_return, stddev_samp(r) AS std_return, stddev_samp(r) FILTER (r < 0) AS downside_deviation, quantile_cont(r, 0.05) AS var_95, quantile_cont(r, 0.95) AS q95 FROM returns GROUP BY 1 HAVING count(*) >= 20"


@query("m8_moments", f"{_R}, m AS ({_MOMENTS}) SELECT key, n, round(mean_return, 9) + 0.0 AS mean_return, round(std_return, 9) + 0.0 AS std_return, round(downside_deviation, 9) + 0.0 AS downside_deviation, round(mean_return / downside_deviation * sqrt(252), 6) + 0.0 AS sortino_ratio, round(var_95, 9) + 0.0 AS var_95, round(abs(q95) / abs(var_95), 6) + 0.0 AS tail_ratio FROM m")
def m8(spark, d):
    m = X.moments(_returns(spark, d))
    return m.select("key", "n", *[r6(c, 9).alias(c) for c in ("mean_return", "std_return", "downside_deviation")], r6("sortino_ratio").alias("sortino_ratio"), r6("var_95", 9).alias("var_95"), r6("tail_ratio").alias("tail_ratio"))


@query("m9_expected_shortfall", f"{_R}, m AS ({_MOMENTS}) SELECT key, round(avg(r), 9) + 0.0 AS cvar_95 FROM returns JOIN m USING (key) WHERE r <= var_95 GROUP BY 1")
def m9(spark, d):
    r = _returns(spark, d)
    return X.expected_shortfall(r, X.moments(r)).withColumn("cvar_95", r6("cvar_95", 9))


@query("m10_calmar", f"{_R}, {_DRAWDOWN}, m AS ({_MOMENTS}), f AS (SELECT key, min(drawdown) AS worst FROM fallen GROUP BY 1) SELECT key, round(worst, 6) + 0.0 AS max_drawdown, round(CASE WHEN abs(worst) > 1e-10 THEN greatest(-100, least(100, mean_return * 252 / abs(worst))) ELSE 0 END, 6) + 0.0 AS calmar_ratio FROM m JOIN f USING (key)")
def m10(spark, d):
    r = _returns(spark, d)
    both = X.moments(r).join(X.max_drawdown(r), "key")
    return both.select("key", r6("max_drawdown").alias("max_drawdown"), r6(X.calmar(F.col("mean_return"), F.col("max_drawdown"))).alias("calmar_ratio"))


def _hurst_sql(cte: str) -> str:
    return f"""base_h AS (SELECT key, r, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM {cte}),
parts AS (SELECT *, i // lag AS chunk FROM (SELECT *, unnest(range(2, least(50, n // 2))) AS lag FROM base_h)),
summed AS (SELECT key, lag, chunk, r, sum(r - m) OVER (PARTITION BY key, lag, chunk ORDER BY i) AS y FROM (SELECT *, avg(r) OVER (PARTITION BY key, lag, chunk) AS m FROM parts WHERE (chunk + 1) * lag <= n)),
rs AS (SELECT key, lag, max(y) - min(y) AS w, stddev_samp(r) AS s FROM summed GROUP BY key, lag, chunk HAVING s > 0),
by_lag AS (SELECT key, ln(lag) AS x, ln(avg(w / s)) AS y FROM rs GROUP BY key, lag HAVING avg(w / s) > 0),
slope AS (SELECT key, CASE WHEN count(*) >= 2 THEN regr_slope(y, x) END AS h FROM by_lag GROUP BY 1)"""


@query("m11_hurst", f"{_R}, {{hurst}} SELECT key, round(coalesce(greatest(0, least(1, h)), 0.5), 6) + 0.0 AS hurst_exponent FROM (SELECT DISTINCT key FROM returns) LEFT JOIN slope USING (key)".replace("{hurst}", _hurst_sql("returns")))
def m11(spark, d):
    return X.hurst(_returns(spark, d)).withColumn("hurst_exponent", r6("hurst_exponent"))


@query("m12_downside_concentration", _R + ", losses AS (SELECT key, -r AS x, row_number() OVER (PARTITION BY key ORDER BY -r) AS i FROM returns WHERE r < 0) SELECT key, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) + 0.0 AS downside_concentration FROM losses GROUP BY 1")
def m12(spark, d):
    return X.concentration(_returns(spark, d)).withColumn("downside_concentration", r6("downside_concentration"))


@query(
    "m13_regime",
    f"{_R}, {_ISLANDS}, s AS (SELECT key, count(*) AS n, stddev_samp(r) AS s FROM returns GROUP BY 1), longest AS (SELECT key, coalesce(max(n) FILTER (ok), 0) AS k FROM runs GROUP BY 1)"
    " SELECT key, round(avg((r >= 0)::INT), 6) + 0.0 AS zero_loss, max((r < 0)::INT) AS has_downside, round(avg((r = 0)::INT), 6) + 0.0 AS constant, round(avg((abs(r) < s * 0.5)::INT), 6) + 0.0 AS low_volatility, any_value(k) AS longest FROM returns JOIN s USING (key) JOIN longest USING (key) WHERE n >= 20 GROUP BY 1",
)
def m13(spark, d):
    got = X.regime(_returns(spark, d))
    share = lambda c, name: r6(f"regime_{c}").alias(name)
    return got.select("key", share("zero_loss_ratio", "zero_loss"), F.col("regime_has_downside_periods").alias("has_downside"), share("constant_return_periods", "constant"), share("low_volatility_ratio", "low_volatility"), F.col("regime_max_consecutive_gains").alias("longest"))


_BASE = "base AS (SELECT key, count(*) AS n, avg(r) AS mean_return, stddev_samp(r) AS std_return, stddev_samp(r) FILTER (r < 0) AS downside_deviation, quantile_cont(r, 0.05) AS var_95, quantile_cont(r, 0.95) AS q95 FROM all_returns GROUP BY 1 HAVING count(*) >= 20 AND stddev_samp(r) >= 1e-10 AND max(r) > min(r)), returns AS (SELECT * FROM all_returns WHERE key IN (SELECT key FROM base))"
_GATED = f"{T.SERIES_SQL}, all_capital AS (SELECT key, date, value + 1e7 AS value FROM series), capital AS (SELECT * FROM all_capital WHERE key IN (SELECT key FROM all_capital GROUP BY 1 HAVING count(*) >= 30 AND max(abs(value)) >= 1e-10)), gains AS (SELECT key, date, (value - lag(value) OVER w) / lag(value) OVER w AS r FROM capital WINDOW w AS (PARTITION BY key ORDER BY date)), all_returns AS (SELECT * FROM gains WHERE r IS NOT NULL), {_BASE}"
_FAMILIES = f"""{_DRAWDOWN}, worst AS (SELECT key, CASE WHEN max(growth) > 0 THEN min(drawdown) ELSE -0.01 END AS max_drawdown FROM fallen GROUP BY 1),
shape AS (SELECT key, skewness(r) AS skewness, kurtosis(r) AS excess_kurtosis FROM returns GROUP BY 1 HAVING count(*) > 3),
tails AS (SELECT key, avg(r) AS cvar_95 FROM returns JOIN base USING (key) WHERE r <= var_95 GROUP BY 1),
vol AS (SELECT key, CASE WHEN stddev_samp(s) > 0 THEN 1 / (1 + stddev_samp(s)) ELSE 1 END AS volatility_stability FROM (SELECT key, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS s FROM returns WINDOW w AS (PARTITION BY key ORDER BY date ROWS 19 PRECEDING)) GROUP BY 1),
monthly AS (SELECT key, count(*) AS months, avg((r > 0)::INT) AS consistency FROM (SELECT key, date_trunc('month', date) AS month, sum(r) AS r FROM returns GROUP BY 1, 2) GROUP BY 1),
{_ISLANDS}, longest AS (SELECT key, coalesce(max(n) FILTER (ok), 0) AS longest FROM runs GROUP BY 1)"""


@query(
    "m14_risk_features",
    f"""WITH {_GATED}, {_FAMILIES}, {_hurst_sql('returns')}, joined AS (
  SELECT key, base.n, mean_return, std_return, downside_deviation, CASE WHEN downside_deviation > 0 THEN mean_return / downside_deviation * sqrt(252) WHEN downside_deviation IS NOT NULL THEN 0 END AS sortino_ratio, var_95,
    CASE WHEN var_95 != 0 THEN abs(q95) / abs(var_95) ELSE 1 END AS tail_ratio, skewness, excess_kurtosis, cvar_95, max_drawdown, h, CASE WHEN base.n >= 40 THEN volatility_stability END AS volatility_stability,
    CASE WHEN base.n >= 60 AND months > 2 THEN consistency END AS monthly_consistency, CASE WHEN abs(max_drawdown) > 1e-10 THEN greatest(-100, least(100, mean_return * 252 / abs(max_drawdown))) ELSE 0 END AS calmar_ratio, longest
  FROM base LEFT JOIN shape USING (key) LEFT JOIN tails USING (key) LEFT JOIN worst USING (key) LEFT JOIN slope USING (key) LEFT JOIN vol USING (key) LEFT JOIN monthly USING (key) LEFT JOIN longest USING (key))
SELECT key, n, round(mean_return, 9) + 0.0 AS mean_return, round(coalesce(std_return, median(std_return) OVER ()), 9) + 0.0 AS std_return, round(coalesce(downside_deviation, median(downside_deviation) OVER ()), 9) + 0.0 AS downside_deviation,
  round(coalesce(sortino_ratio, 0), 6) + 0.0 AS sortino_ratio, round(coalesce(var_95, median(var_95) OVER ()), 9) + 0.0 AS var_95, round(coalesce(cvar_95, median(cvar_95) OVER ()), 9) + 0.0 AS cvar_95, round(coalesce(tail_ratio, 1), 6) + 0.0 AS tail_ratio,
  round(coalesce(skewness, 0), 6) + 0.0 AS skewness, round(coalesce(excess_kurtosis, 0), 6) + 0.0 AS excess_kurtosis, round(coalesce(max_drawdown, -0.1), 6) + 0.0 AS max_drawdown, round(coalesce(greatest(0, least(1, h)), 0.5), 6) + 0.0 AS hurst_exponent,
  round(coalesce(volatility_stability, 0.5), 6) + 0.0 AS volatility_stability, round(coalesce(monthly_consistency, 0.5), 6) + 0.0 AS monthly_consistency, round(calmar_ratio, 6) + 0.0 AS calmar_ratio, longest AS regime_max_consecutive_gains FROM joined""",
)
def m14(spark, d):
    f = X.risk_features(_capital(spark, d))
    nine, six = ["mean_return", "std_return", "downside_deviation", "var_95", "cvar_95"], ["sortino_ratio", "tail_ratio", "skewness", "excess_kurtosis", "max_drawdown", "hurst_exponent", "volatility_stability", "monthly_consistency", "calmar_ratio"]
    return f.select("key", "n", *[r6(c, 9).alias(c) for c in nine], *[r6(c).alias(c) for c in six], "regime_max_consecutive_gains")


@query("j11_feature_families", f"{_R}, m AS ({_MOMENTS}), {T.SIGNALS_SQL} SELECT id, region, round(std_return, 9) + 0.0 AS std_return, score AS metadata_score FROM signals JOIN m ON key = id")
def j11(spark, d):
    m = X.moments(_returns(spark, d)).select(F.col("key").alias("id"), r6("std_return", 9).alias("std_return"))
    return m.join(T.signals(spark, d).select("id", "region", F.col("score").alias("metadata_score")), "id").select("id", "region", "std_return", "metadata_score")
