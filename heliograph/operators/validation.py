"""Scores of a clustering, as aggregates over (key, cluster) labels and (key, feature...) rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.runtime import cut


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


#: Points of a block of silhouette(), at most: two blocks of them meet in a task.
BLOCK_POINTS = 8192
#: Distances that are held at a time.
HELD = 1 << 20


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x and y by one product of matrices; those so small that the product loses digits are taken again from differences."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    d = x @ (-2.0 * y.T)
    d += xx[:, None]
    d += yy
    i, j = np.nonzero(~(d > 1e-4 * (xx.max(initial=0.0) + yy.max(initial=0.0))))
    for k in range(0, len(i), HELD // max(1, x.shape[1])):
        part = slice(k, k + HELD // max(1, x.shape[1]))
        d[i[part], j[part]] = ((x[i[part]] - y[j[part]]) ** 2).sum(1)
    return np.sqrt(d, out=d)


def silhouette(points: DataFrame) -> DataFrame:
    """(n, silhouette) of (key, cluster, vector array<double>) by plain Euclidean distance; members of clusters of one count 0.

    Quadratic in the points, as the measure is: points are dealt into blocks, each two blocks meet once in one task, for the points of both, and what leaves it is
    a sum for each point and cluster.
    """
    rows = cut(points.select(F.monotonically_increasing_id().alias("i"), F.col("cluster").cast("long").alias("c"), F.col("vector").cast("array<double>").alias("v")))
    n, tasks = rows.count(), 2 * points.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK_POINTS), min(-(-n // 256), int(np.ceil(np.sqrt(2 * tasks)))))
    own, other = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each = rows.select("*", own.alias("own"), other.alias("other"))
    both = each.select("i", "c", "v", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def sums(t: pa.Table) -> pa.Table:
        side, i, c = (t[x].to_numpy() for x in ("side", "i", "c"))
        v = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in t["v"].chunks]).reshape(len(side), -1)
        alone, out = t["p"][0].as_py() == t["q"][0].as_py(), []
        sides = [np.flatnonzero(side == 0)] * 2 if alone else [np.flatnonzero(side == s) for s in (0, 1)]
        ours, theirs = (rows[np.argsort(c[rows], kind="stable")] for rows in sides)
        (mine, m), (yours, k) = (np.unique(c[rows], return_counts=True) for rows in (ours, theirs))
        first, head = np.cumsum(m) - m, np.cumsum(k) - k
        forth, back, centre = np.zeros((len(ours), len(yours))), np.zeros((len(mine), len(theirs))), v.mean(0)
        if len(ours) and len(theirs):
            x, y = v[ours] - centre, v[theirs] - centre  # smaller numbers, so that products keep more digits
            step = max(1, HELD // len(theirs))
            for a in range(0, len(ours), step):
                d = distances(x[a : a + step], y)
                if alone:
                    d[np.arange(len(d)), np.arange(a, a + len(d))] = 0.0
                forth[a : a + step] = np.add.reduceat(d, head, axis=1)
                if not alone:
                    at = np.unique(np.maximum(first[(first < a + step) & (first + m > a)], a)) - a
                    back[(first < a + step) & (first + m > a)] += np.add.reduceat(d, at, axis=0)
        for rows, code, size, found in ((ours, yours, k, forth), *(() if alone else ((theirs, mine, m, back.T),))):
            out.append(pa.table({"i": np.repeat(i[rows], len(code)), "ci": np.repeat(c[rows], len(code)), "cj": np.tile(code, len(rows)), "d": found.ravel(), "n": np.tile(size, len(rows)).astype(np.int64)}))
        return pa.concat_tables(out)

    found = both.groupBy("p", "q").applyInArrow(sums, "i long, ci long, cj long, d double, n long").groupBy("i", "ci", "cj").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    mean = F.try_divide(F.col("d"), F.col("n") - (F.col("ci") == F.col("cj")).cast("long"))  # a point isn't its own neighbour
    ab = found.withColumn("d", mean).groupBy("i").agg(F.min(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.where("b IS NOT NULL").agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """(calinski_harabasz): spread between clusters over spread within, each by its degrees of freedom; linear in the points."""
    flat = points.select("key", "cluster", F.posexplode("vector").alias("dim", "v"))
    per = flat.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    total = flat.groupBy("dim").agg(F.avg("v").alias("g"))
    met = per.join(F.broadcast(total), "dim")
    sums = met.agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"))
    size = points.agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("k"))
    return sums.crossJoin(size).select(F.when(F.col("k") > 1, F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))).alias("calinski_harabasz"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """(ari) of (key, first, second) labels."""
    two = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy("first", "second").agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("both"))
    rows = pairs.groupBy("first").agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("f"))
    cols = pairs.groupBy("second").agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("s"))
    all_ = pairs.agg(two(F.count("*")).alias("t"))
    chance = F.try_divide(F.col("f") * F.col("s"), F.col("t"))
    return cells.crossJoin(rows).crossJoin(cols).crossJoin(all_).select(F.coalesce(F.try_divide(F.col("both") - chance, (F.col("f") + F.col("s")) / 2 - chance), F.lit(1.0)).alias("ari"))


def balance(labels: DataFrame) -> DataFrame:
    """(clusters, balance): 1 - deviation of the sizes over their mean, 0 at least."""
    n = labels.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("clusters"), F.greatest(F.lit(0.0), 1 - F.try_divide(F.stddev_pop("n"), F.avg("n"))).alias("balance"))


def separation(points: DataFrame) -> DataFrame:
    """(min_separation, avg_separation) of the clusters' centres."""
    centre = points.where("cluster >= 0").select("cluster", F.posexplode("vector").alias("dim", "v")).groupBy("cluster", "dim").agg(F.avg("v").alias("m"))
    other = centre.select(F.col("cluster").alias("_c"), "dim", F.col("m").alias("_m"))
    d = centre.join(other, "dim").where("cluster < _c").groupBy("cluster", "_c").agg(F.sqrt(F.sum((F.col("m") - F.col("_m")) ** 2)).alias("d"))
    return d.agg(F.min("d").alias("min_separation"), F.avg("d").alias("avg_separation"))


def purity(labels: DataFrame, by: str) -> DataFrame:
    """(purity): share of rows in the most frequent category of their cluster."""
    n = labels.where(F.col(by).isNotNull()).groupBy("cluster", by).agg(F.count("*").alias("n"))
    per = n.groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return per.agg(F.try_divide(F.sum("top").cast("double"), F.sum("n")).alias("purity"))


def numeric_coherence(labels: DataFrame, value: str) -> DataFrame:
    """(coherence): 1 - variance within clusters over all variance, 0 at least."""
    per = labels.groupBy("cluster").agg(F.count(value).alias("n"), F.var_pop(value).alias("v"))
    total = labels.agg(F.var_pop(value).alias("t"))
    return per.agg(F.sum(F.col("n") * F.col("v")).alias("w"), F.sum("n").alias("n")).crossJoin(total).select(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("w"), F.col("n") * F.col("t"))).alias("coherence"))


def feature_coherence(features: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster, coherence): mean over features of 1 / (1 + |cluster mean - mean| / deviation), of clusters but the outliers."""
    flat = features.unpivot("key", columns, "feature", "value")
    all_ = flat.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    per = flat.join(labels, "key").where("cluster >= 0").groupBy("cluster", "feature").agg(F.avg("value").alias("m"))
    off = F.coalesce(F.try_divide(F.abs(F.col("m") - F.col("_m")), F.col("_s")), F.lit(0.0))
    return per.join(F.broadcast(all_), "feature").groupBy("cluster").agg(F.avg(1 / (1 + off)).alias("coherence"))


def risk_homogeneity(features: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """(homogeneity): mean over clusters of 1 / (1 + mean variation coefficient)."""
    flat = features.unpivot("key", columns, "feature", "value").join(labels, "key").where("cluster >= 0")
    cv = flat.groupBy("cluster", "feature").agg(F.try_divide(F.stddev_samp("value"), F.abs(F.avg("value"))).alias("cv"))
    return cv.where("cv IS NOT NULL").groupBy("cluster").agg((1 / (1 + F.avg("cv"))).alias("h")).agg(F.avg("h").alias("homogeneity"))


def similarity(pairs: DataFrame) -> DataFrame:
    """(similarity) of (x, y) rows: |correlation|; constants are alike if both are, and else not."""
    s = pairs.agg(F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"))
    flat = lambda c: F.coalesce(F.col(c), F.lit(0.0)) < 1e-10
    return s.select(F.when(flat("sx") & flat("sy"), 1.0).when(flat("sx") | flat("sy"), 0.0).otherwise(F.abs(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")))).alias("similarity"))


def perturbed(features: DataFrame, columns: list[str], share: float = 0.05, seed: int = 42) -> DataFrame:
    """Columns with Gaussian noise of a share of their deviation, drawn from (seed, key) so that it doesn't depend on partitions."""
    stats = features.agg(*[F.stddev_samp(c).alias(f"_s{c}") for c in columns])
    out = features.crossJoin(F.broadcast(stats))
    unit = lambda *salt: (F.pmod(F.xxhash64(F.col("key"), *[F.lit(s) for s in salt]), F.lit(2**40)) + 1) / F.lit(float(2**40 + 1))
    for i, c in enumerate(columns):
        noise = F.sqrt(-2 * F.log(unit(seed, i, 0))) * F.cos(2 * 3.141592653589793 * unit(seed, i, 1))
        out = out.withColumn(c, F.col(c) + noise * share * F.coalesce(F.col(f"_s{c}"), F.lit(0.0)))
    return out.drop(*[f"_s{c}" for c in columns])


def stability(trials: DataFrame) -> DataFrame:
    """(trial_a, trial_b, ari) of (trial, key, cluster) labels, for every pair of trials."""
    a, b = trials.select("key", F.col("trial").alias("trial_a"), F.col("cluster").alias("first")), trials.select("key", F.col("trial").alias("trial_b"), F.col("cluster").alias("second"))
    met = a.join(b, "key").where("trial_a < trial_b")
    two = lambda n: n * (n - 1) / 2
    by = ["trial_a", "trial_b"]
    count = lambda *more: met.groupBy(*by, *more).agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias("_".join(["x", *more])))
    all_ = met.groupBy(*by).agg(two(F.count("*")).alias("t"))
    chance = F.try_divide(F.col("x_first") * F.col("x_second"), F.col("t"))
    out = count("first", "second").join(count("first"), by).join(count("second"), by).join(all_, by)
    return out.select(*by, F.coalesce(F.try_divide(F.col("x_first_second") - chance, (F.col("x_first") + F.col("x_second")) / 2 - chance), F.lit(1.0)).alias("ari"))


def overall(scores: DataFrame) -> DataFrame:
    """scores (silhouette, stability, coherence, homogeneity; null where missing) with `overall`: their mean weighted .3, .25, .25, .2 over what is there, the silhouette mapped to 0..1."""
    parts = [((F.col("silhouette") + 1) / 2, 0.3), (F.col("stability"), 0.25), (F.col("coherence"), 0.25), (F.col("homogeneity"), 0.2)]
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    under = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return scores.withColumn("overall", F.try_divide(top, under))


def windowed_stability(series: DataFrame, windows: DataFrame, labels: DataFrame) -> DataFrame:
    """(window, similarity): for each window of dates, the mean correlation of a key's changes with the mean change of its cluster."""
    w = Window.partitionBy("window", "key").orderBy("date")
    rows = series.join(F.broadcast(windows), "date").join(labels, "key").withColumn("d", F.col("value") - F.lag("value").over(w)).where("d IS NOT NULL")
    centre = rows.withColumn("m", F.avg("d").over(Window.partitionBy("window", "cluster", "date")))
    each = centre.groupBy("window", "key").agg(F.try_divide(F.covar_samp("d", "m"), F.stddev_samp("d") * F.stddev_samp("m")).alias("c"))
    return each.groupBy("window").agg(F.avg("c").alias("similarity"))
