"""Queries over features and clusters: scaling, reduction, clustering, profiles and scores.

Embeddings and their labels are the points; where a kernel is quadratic in the keys, the suppliers' series are.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heliograph.operators import clustering as K
from heliograph.operators import correlation as C
from heliograph.operators import features as X
from heliograph.operators import gathered as B
from heliograph.operators import series as S
from heliograph.operators import validation as V
from heliograph.plans.registry import query, r6
from heliograph.plans.series_queries import _P, _returns
from heliograph.runtime import cut
from heliograph.sources import tables as T

_POINTS_SQL = "points AS (SELECT vec_id AS key, label AS cluster, embedding::DOUBLE[] AS vector FROM embeddings)"
_PARTS_SQL = "parts AS (SELECT p_partkey AS key, p_size::DOUBLE AS size, p_retailprice AS price, p_partkey % 5 AS cluster FROM part)"
_LONG_SQL = f"{_PARTS_SQL}, long AS (SELECT key, cluster, 'price' AS feature, price AS value FROM parts UNION ALL SELECT key, cluster, 'size', size FROM parts)"
_COLUMNS = ["price", "size"]


def _points(spark, d):
    return T.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("vector"))


def _parts(spark, d):
    """(key, size, price, cluster): a table of features with labels."""
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 5).cast("int").alias("cluster"))


def _features(spark, d):
    """(key, ...): moments of each supplier's returns, stored once: what fits a model reads them many times."""
    return cut(X.moments(_returns(spark, d)).drop("n"))


_MOMENTS = ["mean_return", "std_return", "downside_deviation", "sortino_ratio", "var_95", "tail_ratio"]

# --- scaling ---


@query("m18_standardised", f"WITH {_PARTS_SQL} SELECT key, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) + 0.0 AS price, round((size - avg(size) OVER ()) / stddev_pop(size) OVER (), 6) + 0.0 AS size FROM parts")
def m18(spark, d):
    return X.standardised(_parts(spark, d), _COLUMNS).select("key", r6("price").alias("price"), r6("size").alias("size"))


@query("m19_robust_scaled", f"WITH {_PARTS_SQL}, q AS (SELECT quantile_cont(price, [0.5, 0.05, 0.95]) AS p, quantile_cont(size, [0.5, 0.05, 0.95]) AS s FROM parts) SELECT key, round((price - p[1]) / (p[3] - p[2]), 6) + 0.0 AS price, round((size - s[1]) / (s[3] - s[2]), 6) + 0.0 AS size FROM parts, q")
def m19(spark, d):
    return X.robust_scaled(_parts(spark, d), _COLUMNS).select("key", r6("price").alias("price"), r6("size").alias("size"))


@query("m39_imputed_and_clipped", f"WITH {_PARTS_SQL}, holes AS (SELECT key, CASE WHEN key % 10 = 3 THEN NULL WHEN key % 10 = 4 THEN 1e6 ELSE price END AS price FROM parts), full_ AS (SELECT key, coalesce(price, (SELECT median(price) FROM holes)) AS price FROM holes), s AS (SELECT avg(price) AS m, stddev_samp(price) AS d FROM full_) SELECT key, round(greatest(m - 2 * d, least(m + 2 * d, price)), 4) + 0.0 AS price FROM full_, s")
def m39(spark, d):
    holes = _parts(spark, d).select("key", F.when(F.col("key") % 10 == 3, float("inf")).when(F.col("key") % 10 == 4, 1e6).otherwise(F.col("price")).alias("price"))
    return X.clipped(X.imputed(holes, ["price"]), ["price"], 2.0).withColumn("price", r6("price", 4))


@query("m39_clipped_default", f"WITH {_PARTS_SQL}, s AS (SELECT avg(price) AS m, stddev_samp(price) AS d FROM parts) SELECT key, round(greatest(m - 5 * d, least(m + 5 * d, price)), 4) + 0.0 AS price FROM parts, s")
def m39_default(spark, d):
    return X.clipped(_parts(spark, d), ["price"]).select("key", r6("price", 4).alias("price"))


@query("a27_long_form", f"WITH {_LONG_SQL} SELECT key, feature, value FROM long")
def a27(spark, d):
    return X.long_form(_parts(spark, d).withColumn("flat", F.lit(1.0)), [*_COLUMNS, "flat"])


# --- clusters and what describes them ---


@query("a24_cluster_sizes", "SELECT label AS cluster, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM embeddings GROUP BY 1")
def a24(spark, d):
    return K.in_order(K.sizes(_points(spark, d)))


_PROFILE = f"{_LONG_SQL}, overall AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY 1), profile AS (SELECT cluster, feature, avg(value) AS mean, stddev_samp(value) AS std, (avg(value) - any_value(m)) / any_value(s) AS z FROM long JOIN overall USING (feature) GROUP BY 1, 2)"


@query("a25_profiles", f"WITH {_PROFILE} SELECT cluster, feature, round(mean, 4) AS mean, round(std, 4) AS std, round(z, 6) + 0.0 AS z, abs(z) > 0.01 AS distinctive, CASE WHEN z >= 0 THEN 'high' ELSE 'low' END AS direction FROM profile")
def a25(spark, d):
    p = _parts(spark, d)
    return K.profiles(p.drop("cluster"), p.select("key", "cluster"), _COLUMNS, 0.01).select("cluster", "feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), r6("z").alias("z"), "distinctive", "direction")


@query("a25_profiles_default", f"WITH {_PROFILE} SELECT cluster, feature, round(z, 6) + 0.0 AS z, abs(z) > 1.5 AS distinctive FROM profile")
def a25_default(spark, d):
    p = _parts(spark, d)
    return K.profiles(p.drop("cluster"), p.select("key", "cluster"), _COLUMNS).select("cluster", "feature", r6("z").alias("z"), "distinctive")


@query("a25_interpretation", f"WITH {_PROFILE} SELECT cluster, string_agg(CASE WHEN z >= 0 THEN 'high ' ELSE 'low ' END || feature, ' | ' ORDER BY abs(z) DESC, feature) AS text FROM profile GROUP BY 1")
def a25_text(spark, d):
    p = _parts(spark, d)
    return K.interpretation(K.profiles(p.drop("cluster"), p.select("key", "cluster"), _COLUMNS))


@query("m28_inertia", f"{_P}, labels AS (SELECT s_suppkey AS key, s_suppkey % 4 AS cluster FROM supplier), near AS (SELECT x.cluster, sum(2 * (1 - corr)) AS s FROM pairs JOIN labels x ON a = x.key JOIN labels y ON b = y.key AND x.cluster = y.cluster GROUP BY 1) SELECT cluster, round(coalesce(s, 0) / count(*), 4) + 0.0 AS inertia FROM labels LEFT JOIN near USING (cluster) GROUP BY cluster, s")
def m28(spark, d):
    labels = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 4).alias("cluster"))
    return B.pair_inertia(T.series(spark, d), labels, lambda corr: 2 * (1 - corr)).withColumn("inertia", r6("inertia", 4))


# --- scores ---


@query(
    "m32_silhouette",
    f"WITH {_POINTS_SQL}, d AS (SELECT i.key AS i, i.cluster AS ci, j.cluster AS cj, avg(list_distance(i.vector, j.vector)) AS d FROM points i, points j WHERE i.key != j.key GROUP BY 1, 2, 3), ab AS (SELECT i, min(d) FILTER (ci = cj) AS a, min(d) FILTER (ci != cj) AS b FROM d GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM ab WHERE b IS NOT NULL",
)
def m32(spark, d):
    return V.silhouette(_points(spark, d)).withColumn("silhouette", r6("silhouette"))


_FLAT = "flat AS (SELECT key, cluster, unnest(vector) AS v, unnest(range(len(vector))) AS dim FROM points)"


@query("m32_calinski_harabasz", f"WITH {_POINTS_SQL}, {_FLAT}, per AS (SELECT cluster, dim, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM flat GROUP BY 1, 2), g AS (SELECT dim, avg(v) AS g FROM flat GROUP BY 1), k AS (SELECT count(*) AS n, count(DISTINCT cluster) AS k FROM points) SELECT round(sum(per.n * (m - g) ** 2) * (any_value(k.n) - any_value(k)) / (sum(per.n * s) * (any_value(k) - 1)), 4) + 0.0 AS calinski_harabasz FROM per JOIN g USING (dim), k")
def m32_ch(spark, d):
    return V.calinski_harabasz(_points(spark, d)).withColumn("calinski_harabasz", r6("calinski_harabasz", 4))


def _ari_sql(cells: str) -> str:
    two = "{0} * ({0} - 1) / 2"
    side = lambda c: f"(SELECT sum({two.format('n')}) FROM (SELECT sum(n) AS n FROM c GROUP BY {c}))"
    return f"c AS ({cells}), x AS (SELECT (SELECT sum({two.format('n')}) FROM c) AS joint, {side('first')} AS f, {side('second')} AS s, (SELECT {two.format('sum(n)')} FROM c) AS t)"


@query("m33_adjusted_rand", f"WITH {_ari_sql('SELECT label AS first, vec_id % 4 + 2 * (label // 5) AS second, count(*) AS n FROM embeddings GROUP BY 1, 2')} SELECT round((joint - f * s / t) / ((f + s) / 2 - f * s / t), 6) + 0.0 AS ari FROM x")
def m33(spark, d):
    e = T.table(spark, d, "embeddings")
    return V.adjusted_rand(e.select(F.col("vec_id").alias("key"), F.col("label").alias("first"), (F.col("vec_id") % 4 + 2 * F.expr("label div 5")).alias("second"))).withColumn("ari", r6("ari"))


@query("m33_perturbation_stability")
def m33_stability(spark, d):
    f, trials = _features(spark, d), None
    for i in range(3):
        noisy = X.standardised(V.perturbed(f, _MOMENTS, seed=i), _MOMENTS)
        one = K.kmeans(noisy, _MOMENTS, k=3).select(F.lit(i).alias("trial"), "key", "cluster")
        trials = one if trials is None else trials.unionByName(one)
    return V.stability(trials)


@query("m34_balance", "WITH n AS (SELECT count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS clusters, round(greatest(0, 1 - stddev_pop(n) / avg(n)), 6) + 0.0 AS balance FROM n")
def m34(spark, d):
    return V.balance(_points(spark, d)).withColumn("balance", r6("balance"))


@query("m34_separation", f"WITH {_POINTS_SQL}, {_FLAT}, c AS (SELECT cluster, dim, avg(v) AS m FROM flat GROUP BY 1, 2), s AS (SELECT sqrt(sum((x.m - y.m) ** 2)) AS d FROM c x JOIN c y ON x.dim = y.dim AND x.cluster < y.cluster GROUP BY x.cluster, y.cluster) SELECT round(min(d), 6) AS min_separation, round(avg(d), 6) AS avg_separation FROM s")
def m34_separation(spark, d):
    return V.separation(_points(spark, d)).select(F.round("min_separation", 6).alias("min_separation"), F.round("avg_separation", 6).alias("avg_separation"))


@query("m35_feature_coherence", f"WITH {_PROFILE} SELECT cluster, round(avg(1 / (1 + abs(z))), 6) + 0.0 AS coherence FROM profile GROUP BY 1")
def m35(spark, d):
    p = _parts(spark, d)
    return V.feature_coherence(p.drop("cluster"), p.select("key", "cluster"), _COLUMNS).withColumn("coherence", r6("coherence"))


@query("m36_purity", "WITH n AS (SELECT c_nationkey AS cluster, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), p AS (SELECT max(n) AS top, sum(n) AS n FROM n GROUP BY cluster) SELECT round(sum(top) / sum(n), 6)::DOUBLE AS purity FROM p")
def m36(spark, d):
    return V.purity(T.table(spark, d, "customer").withColumnRenamed("c_nationkey", "cluster"), "c_mktsegment").withColumn("purity", r6("purity"))


@query("m36_numeric_coherence", "WITH p AS (SELECT count(*) AS n, var_pop(c_acctbal) AS v FROM customer GROUP BY c_nationkey) SELECT round(greatest(0, 1 - sum(n * v) / (sum(n) * (SELECT var_pop(c_acctbal) FROM customer))), 6)::DOUBLE AS coherence FROM p")
def m36_numeric(spark, d):
    return V.numeric_coherence(T.table(spark, d, "customer").withColumnRenamed("c_nationkey", "cluster"), "c_acctbal").withColumn("coherence", r6("coherence"))


@query("m37_risk_homogeneity", f"WITH {_LONG_SQL}, cv AS (SELECT cluster, stddev_samp(value) / abs(avg(value)) AS cv FROM long GROUP BY cluster, feature), h AS (SELECT 1 / (1 + avg(cv)) AS h FROM cv GROUP BY cluster) SELECT round(avg(h), 6) + 0.0 AS homogeneity FROM h")
def m37(spark, d):
    p = _parts(spark, d)
    return V.risk_homogeneity(p.drop("cluster"), p.select("key", "cluster"), _COLUMNS).withColumn("homogeneity", r6("homogeneity"))


@query("m38_similarity", "SELECT round(abs(corr(l_quantity, l_extendedprice)), 6) + 0.0 AS similarity FROM lineitem")
def m38(spark, d):
    return V.similarity(T.table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))).withColumn("similarity", r6("similarity"))


@query("m40_overall_score", "SELECT * FROM (VALUES (1, 0.7), (2, 0.72), (3, 0.6), (4, NULL)) t(id, overall)")
def m40(spark, d):
    rows = [(1, 0.4, 0.7, 0.7, 0.7), (2, 0.8, 0.5, None, None), (3, None, None, 0.6, None), (4, None, None, None, None)]
    got = V.overall(spark.createDataFrame(rows, "id int, silhouette double, stability double, coherence double, homogeneity double"))
    return got.select("id", r6(F.round("overall", 2)).alias("overall"))


@query("m40_scores_of_a_table", """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_size <= 40 THEN p_size::DOUBLE / 25 - 1 END AS silhouette, CASE WHEN p_size % 3 != 0 THEN p_retailprice / 2500 END AS stability, CASE WHEN p_size % 5 != 0 THEN p_size::DOUBLE / 50 END AS coherence, CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE END AS homogeneity FROM part)
SELECT id, round((coalesce((silhouette + 1) / 2 * 0.3, 0) + coalesce(stability * 0.25, 0) + coalesce(coherence * 0.25, 0) + coalesce(homogeneity * 0.2, 0))::DOUBLE / nullif((silhouette IS NOT NULL)::DOUBLE * 0.3 + (stability IS NOT NULL)::DOUBLE * 0.25 + (coherence IS NOT NULL)::DOUBLE * 0.25 + (homogeneity IS NOT NULL)::DOUBLE * 0.2, 0), 9) AS overall FROM s""")
def m40_table(spark, d):
    size = F.col("p_size")
    scores = T.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(size <= 40, size / 25 - 1).alias("silhouette"), F.when(size % 3 != 0, F.col("p_retailprice") / 2500).alias("stability"), F.when(size % 5 != 0, size / 50).alias("coherence"), F.when(size % 2 == 0, 0.5).alias("homogeneity")
    )
    return V.overall(scores).select("id", r6("overall", 9).alias("overall"))


@query(
    "m15_window_stability",
    """WITH e AS (SELECT user_id % 5 AS key, ts::DATE AS date, sum(value) AS value FROM events GROUP BY 1, 2), shared AS (SELECT date FROM e GROUP BY 1 HAVING count(DISTINCT key) = (SELECT count(DISTINCT key) FROM e)),
ranked AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n FROM shared), starts AS (SELECT unnest(range(0, max(n) - 9, greatest(1, max(n) // 10)))::INT AS win FROM ranked),
rows_ AS (SELECT win, key, key % 2 AS cluster, date, value - lag(value) OVER (PARTITION BY win, key ORDER BY date) AS d FROM e JOIN ranked USING (date) JOIN starts ON place >= win AND place < win + 10),
centred AS (SELECT win, key, d, avg(d) OVER (PARTITION BY win, cluster, date) AS m FROM rows_ WHERE d IS NOT NULL),
each AS (SELECT win, key, corr(d, m) AS c FROM centred GROUP BY 1, 2)
SELECT win AS "window", round(avg(c), 6) + 0.0 AS similarity FROM each GROUP BY 1""",
)
def m15_windows(spark, d):
    e = T.table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("key"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("value"))
    return V.windowed_stability(e, S.moving_windows(S.common_calendar(e), 10), e.select("key", (F.col("key") % 2).alias("cluster")).distinct()).withColumn("similarity", r6("similarity"))


# --- kernels that SQL can't express ---


@query("m15_spiked_covariance")
def m15(spark, d):
    w = Window.partitionBy("key").orderBy("date")
    e = T.table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("key"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("value"))
    return K.spiked(e.select("key", "date", S.capital_return(F.col("value"), w).alias("r")).where("r IS NOT NULL"))


@query("m20_principal_components")
def m20(spark, d):
    return K.principal_components(_features(spark, d), _MOMENTS)[0]


@query("m21_tsne")
def m21(spark, d):
    return K.layout(_features(spark, d), _MOMENTS, "tsne")


@query("m22_neighbour_layout")
def m22(spark, d):
    return K.layout(_features(spark, d), _MOMENTS, "neighbours")


@query("m23_scaling_of_distances")
def m23(spark, d):
    return K.mds(C.correlate(T.series(spark, d)), refine=True)


@query("m24_density_clusters")
def m24(spark, d):
    return K.hdbscan(_features(spark, d), _MOMENTS)


@query("m25_kmeans")
def m25(spark, d):
    return K.kmeans(X.standardised(_features(spark, d), _MOMENTS), _MOMENTS)


@query("m26_hierarchical_clusters")
def m26(spark, d):
    return K.hierarchical(C.correlate(T.series(spark, d)))


@query("m29_risk_parity")
def m29(spark, d):
    return K.risk_parity(C.correlate(T.series(spark, d)), _features(spark, d))


@query("a26_feature_importance")
def a26(spark, d):
    f = _features(spark, d)
    return K.importance(f, K.kmeans(X.standardised(f, _MOMENTS), _MOMENTS, k=3), _MOMENTS)
