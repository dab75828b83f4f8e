"""What is taken of the pairs of a block in the task that correlates them, so that pairs needn't become rows: partial results, far fewer than pairs, that Spark puts together.

Every function here takes series (key, date, value) and gives what its namesake of correlation, graph or clustering gives for correlate(series).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators import correlation as C
from heliograph.operators import graph as G
from heliograph.runtime import cut

#: Up to so many keys a median is taken of all correlations of a key; beyond, of those between two bounds that so many partners suggest (checked, and widened where they fail).
WHOLE, SAMPLE = 4096, 2048
#: Edges that a task holds before it keeps only their forest.
EDGES = 1 << 20


def _kept(mask: np.ndarray, value: np.ndarray, fill: float) -> np.ndarray:
    return np.where(mask, value, fill)


def positive_max(left: DataFrame) -> DataFrame:
    """correlation.positive_max of all pairs."""

    def gather(keys, tags, tiles, alone) -> Iterator[dict]:
        best, seen = np.full(len(keys), -np.inf), np.zeros(len(keys), bool)
        for x, y, n, (_, corr) in tiles:
            w = _kept((n > 0) & ~np.isnan(corr), corr, -np.inf)
            for at, axis in ((x, 1), (y, 0)):
                best[at] = np.maximum(best[at], w.max(axis))
                seen[at] |= (n > 0).any(axis)
        yield {"key": keys[seen], "corr": np.where(best > -np.inf, best, np.nan)[seen]}

    part = C.correlated(left, gather=gather, schema="key key, corr double")
    return part.groupBy("key").agg(F.greatest(F.max("corr"), F.lit(0.0)).alias("correlation"))


def best_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """correlation.best_match of pairs of the two."""

    def gather(keys, tags, tiles, alone) -> Iterator[dict]:
        best, of = np.full(len(keys), -1.0), np.full(len(keys), -1)
        for x, y, n, (_, corr) in tiles:
            w = np.abs(_kept((n > 0) & ~np.isnan(corr), corr, np.nan))
            w = np.where(np.isnan(w), -1.0, w)
            at = w.argmax(1)  # the first, which is the least key
            top = w[np.arange(len(x)), at]
            more = (top > best[x]) | ((top == best[x]) & (top >= 0) & (y[at] < of[x]))
            best[x[more]], of[x[more]] = top[more], y[at[more]]
        found = of >= 0
        yield {"a": keys[found], "b": keys[of[found]], "corr": best[found]}

    return C.best_match(C.correlated(left, right, gather=gather, schema="a key, b key, corr double"))


def edges(left: DataFrame, threshold: float) -> DataFrame:
    """graph.network of all pairs: (a, b, corr); weaker pairs don't leave their task."""

    def strong(tiles):
        for x, y, n, (m, corr) in tiles:
            yield x, y, np.where(np.abs(_kept(n > 0, corr, 0.0)) >= threshold, n, 0), [m, corr]

    def gather(keys, tags, tiles, alone) -> Iterator[dict]:
        yield from C.as_pairs(["n", "corr"])(keys, tags, strong(tiles), alone)

    return C.correlated(left, gather=gather, schema="a key, b key, corr double")


def degrees(left: DataFrame, threshold: float) -> DataFrame:
    """graph.degrees of edges()."""

    def gather(keys, tags, tiles, alone) -> Iterator[dict]:
        many = np.zeros(len(keys), np.int64)
        for x, y, n, (_, corr) in tiles:
            on = np.abs(_kept(n > 0, corr, 0.0)) >= threshold
            many[x] += on.sum(1)
            many[y] += on.sum(0)
        yield {"id": keys[many > 0], "degree": many[many > 0]}

    return C.correlated(left, gather=gather, schema="id key, degree long").groupBy("id").agg(F.sum("degree").alias("degree"))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least place of each component) once the edges a, b are added."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def components(left: DataFrame, threshold: float) -> DataFrame:
    """graph.components of edges(): each block tells which of its keys hang together, and only that leaves the task."""

    def gather(keys, tags, tiles, alone) -> Iterator[dict]:
        label, some = np.arange(len(keys)), np.zeros(len(keys), bool)
        for x, y, n, (_, corr) in tiles:
            i, j = np.nonzero(np.abs(_kept(n > 0, corr, 0.0)) >= threshold)
            label = _joined(label, x[i], y[j])
        some = label != np.arange(len(keys))
        yield {"a": keys[some], "b": keys[label[some]]}

    return G.components(C.correlated(left, gather=gather, schema="a key, b key"))


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, nodes: int) -> np.ndarray:
    """Which of the edges, in the order of w, a, b (nan last), are in the least spanning forest (Boruvka)."""
    order = np.lexsort((b, a, w))
    a, b, label, chosen = a[order], b[order], np.arange(nodes), np.zeros(len(order), bool)
    rank = np.arange(len(order))
    while True:
        p, q = label[a[rank]], label[b[rank]]
        apart = p != q
        if not apart.any():
            return np.sort(order[chosen])
        rank, p, q = rank[apart], p[apart], q[apart]
        least = np.full(nodes, len(order))
        np.minimum.at(least, p, rank)
        np.minimum.at(least, q, rank)
        new = np.unique(least[least < len(order)])
        chosen[new] = True
        label = _joined(label, a[new], b[new])


def minimum_spanning_tree(left: DataFrame, weight) -> DataFrame:
    """graph.minimum_spanning_tree of all pairs by weight(correlations), an array function: an edge that isn't in the forest of its block isn't in that of all.

    Forests of blocks are put together twice: in as many tasks as there are cores, and in one, which gets a forest from each.
    """

    def gather(keys, tags, tiles, alone) -> Iterator[dict]:
        a, b, w, new, size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), [], 0
        light = [(a, b, w)]

        def reduced(parts):
            a, b, w = (np.concatenate(c) for c in zip(*parts, strict=True))
            keep = forest(a, b, w, len(keys))
            return a[keep], b[keep], w[keep]

        for x, y, n, (_, corr) in tiles:
            d = weight(corr)
            heavy = np.where((n > 0) & ~np.isnan(d), d, np.inf)
            for i, j in ((np.arange(len(x)), heavy.argmin(1)), (heavy.argmin(0), np.arange(len(y)))):  # each key's lightest edge here, which makes trees to tell others by
                there = heavy[i, j] < np.inf
                light.append((x[i[there]], y[j[there]], heavy[i[there], j[there]]))
            light = [reduced(light)]
            label, most = _joined(np.arange(len(keys)), *light[0][:2]), np.full(len(keys), -np.inf)
            np.maximum.at(most, label[light[0][0]], light[0][2])
            # an edge heavier than all those that join its ends' tree closes a circle
            i, j = np.nonzero((n > 0) & ((label[x][:, None] != label[y]) | (heavy <= most[label[x]][:, None])))
            new.append((np.minimum(x[i], y[j]), np.maximum(x[i], y[j]), d[i, j]))
            size += len(i)
            if size > EDGES:
                new, size = [reduced(new)], 0
        if new:
            a, b, w = reduced(new)
        yield {"a": keys[a], "b": keys[b], "w": w}

    parts = cut(C.correlated(left, gather=gather, schema="a key, b key, w double"))
    schema = parts.schema

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if batches:
            t = pa.Table.from_batches(batches)
            ends = np.concatenate([np.array(t[c].to_pylist(), object if pa.types.is_string(t[c].type) else np.int64) for c in "ab"])
            keys, at = np.unique(ends, return_inverse=True)
            keep = forest(at[: len(t)], at[len(t) :], t["w"].to_numpy(zero_copy_only=False), len(keys))
            yield from t.take(pa.array(keep)).to_batches()

    tasks = left.sparkSession.sparkContext.defaultParallelism
    whole = parts.repartition(tasks).mapInArrow(again, schema).coalesce(1).mapInArrow(again, schema)
    return whole.withColumnRenamed("w", "distance")


def pair_inertia(left: DataFrame, labels: DataFrame, squared) -> DataFrame:
    """clustering.pair_inertia of all pairs; squared(correlations) gives squared distances of arrays."""
    own = labels.select("key", F.col("cluster").cast("double").alias("tag"))
    kind = labels.schema["cluster"].dataType

    def gather(keys, tags, tiles, alone) -> Iterator[dict]:
        cluster, code = np.unique(tags[~np.isnan(tags)], return_inverse=True)
        of = np.full(len(keys), -1)
        of[~np.isnan(tags)] = code
        sums = np.zeros(len(cluster))
        for x, y, n, (_, corr) in tiles:
            d = _kept((n > 0) & ~np.isnan(corr) & (of[x][:, None] == of[y]), squared(corr), 0.0).sum(1)
            sums += np.bincount(of[x][of[x] >= 0], d[of[x] >= 0], len(cluster))
        yield {"cluster": cluster, "s": sums}

    met = C.correlated(left, gather=gather, schema="cluster double, s double", tags=own).groupBy("cluster").agg(F.sum("s").alias("s"))
    n = labels.groupBy("cluster").agg(F.count("*").alias("m"))
    return n.join(met.select(F.col("cluster").cast(kind).alias("cluster"), "s"), "cluster", "left").select("cluster", (F.coalesce("s", F.lit(0.0)) / F.col("m")).alias("inertia"))


def _stats(bounds: bool):
    """Gathers, for each key, count, sum, least, greatest, and the correlations between its bounds with the number of those below."""

    def gather(keys, tags, tiles, alone) -> Iterator[dict]:
        lo, hi = (tags[:, 0], tags[:, 1]) if bounds else (np.full(len(keys), -np.inf), np.full(len(keys), np.inf))
        lo, hi = np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)
        many, below, total, least, most = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.full(len(keys), np.inf), np.full(len(keys), -np.inf)
        where, values = [], []
        for x, y, n, (_, corr) in tiles:
            ok = (n > 0) & ~np.isnan(corr)
            if not alone:
                ok &= keys[x][:, None] != keys[y]
            for at, axis, one in ((x, 1, lambda v: v[:, None]), *(((y, 0, lambda v: v),) if alone else ())):
                many[at] += ok.sum(axis)
                total[at] += _kept(ok, corr, 0.0).sum(axis)
                least[at] = np.minimum(least[at], _kept(ok, corr, np.inf).min(axis))
                most[at] = np.maximum(most[at], _kept(ok, corr, -np.inf).max(axis))
                under = ok & (corr < one(lo[at]))
                below[at] += under.sum(axis)
                i, j = np.nonzero(ok & ~under & (corr <= one(hi[at])))
                where.append(at[i if axis else j].astype(np.int32))
                values.append(corr[i, j])
        if where:
            where, values = np.concatenate(where), np.concatenate(values)
            values = values[np.argsort(where, kind="stable")]
            edge = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(keys)))])
            some = np.flatnonzero(many)
            for part in np.array_split(some, max(1, len(values) >> 20)):
                yield {"key": keys[part], "n": many[part], "total": total[part], "least": least[part], "most": most[part], "below": below[part], "inside": [values[edge[k] : edge[k + 1]].tobytes() for k in part]}

    return gather


_STATS = "key key, n long, total double, least double, most double, below long, inside binary"


def _medians(parts: DataFrame) -> DataFrame:
    """(key, least, greatest, mean and median); the median is null where it isn't between the bounds."""
    one = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("below").alias("below"), F.collect_list("inside").alias("inside"))

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for n, below, inside in zip(t["n"].to_pylist(), t["below"].to_pylist(), t["inside"].to_pylist(), strict=True):
                v = np.frombuffer(b"".join(inside))
                a, b = (n - 1) // 2 - below, n // 2 - below
                out.append(float(np.partition(v, (a, b))[[a, b]].mean()) if 0 <= a and b < len(v) else None)
            yield pa.RecordBatch.from_arrays([t["key"], t["n"], t["total"], t["least"], t["most"], pa.array(out, pa.float64())], ["key", "n", "total", "least", "most", "median_correlation"])

    kind = parts.schema["key"].dataType.simpleString()
    got = one.mapInArrow(medians, f"key {kind}, n long, total double, least double, most double, median_correlation double")
    return got.select("key", F.col("least").alias("min_correlation"), F.col("most").alias("max_correlation"), (F.col("total") / F.col("n")).alias("avg_correlation"), "median_correlation")


def summary(left: DataFrame) -> DataFrame:
    """correlation.summary of all pairs.

    A pair is correlated once, for both of its keys.  Of more than WHOLE keys, bounds for each key's median come from its correlations with about SAMPLE others; only what lies between goes
    through the shuffle.  The counts tell whether the median is there: if not, the key meets all others again, without bounds.
    """
    series = cut(C.packed(left))
    n = series.count()
    if n <= WHOLE:
        return _medians(C.correlated(series, gather=_stats(False), schema=_STATS))

    def bounds(keys, tags, tiles, alone) -> Iterator[dict]:
        found: dict[int, list] = {}
        for x, _, n, (_, corr) in tiles:
            found.setdefault(int(x[0]), [x]).append(_kept(n > 0, corr, np.nan))
        for x, *parts in found.values():
            v = np.sort(np.concatenate(parts, 1), 1)
            m = (~np.isnan(v)).sum(1)
            away = 2 * np.sqrt(m) + 1  # four deviations of the median's rank
            low, high = np.floor(m / 2 - away).astype(int), np.ceil(m / 2 + away).astype(int)
            row = np.arange(len(x))
            yield {"key": keys[x], "lo": np.where(low >= 0, v[row, np.maximum(low, 0)], -np.inf), "hi": np.where(high < m, v[row, np.minimum(high, v.shape[1] - 1)], np.inf)}

    few = series.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(max(1, n // SAMPLE))) == 0)
    ends = C.correlated(series, few, gather=bounds, schema="key key, lo double, hi double").groupBy("key").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    first = cut(_medians(C.correlated(series, gather=_stats(True), schema=_STATS, tags=ends)))
    missed = cut(first.where("median_correlation IS NULL").select("key"))
    if missed.isEmpty():
        return first
    rest = _medians(C.correlated(series.join(missed, "key", "left_semi"), series, gather=_stats(False), schema=_STATS))
    return first.where("median_correlation IS NOT NULL").unionByName(rest)


def head(left: DataFrame, n: int = 50) -> DataFrame:
    """filters.first_of_matrix of all pairs: only the first keys meet all others, to tell which have a pair, and then each other."""

    def gather(keys, tags, tiles, alone) -> Iterator[dict]:
        seen = np.zeros(len(keys), bool)
        for x, y, n, _ in tiles:
            seen[x] |= ((n > 0) & (keys[x][:, None] != keys[y])).any(1)
        yield {"key": keys[seen]}

    series = cut(C.packed(left))
    whole, tried = series.count(), n + 14
    while True:
        some = C.correlated(cut(series.orderBy("key").limit(tried)), series, gather=gather, schema="key key").distinct().orderBy("key").limit(n)
        some = cut(some)
        if tried >= whole or some.count() >= n:
            return C.correlate(series.join(F.broadcast(some), "key", "left_semi"))
        tried *= 2
