"""Pairwise correlation of returns over the dates that two series share.

Returns are taken between consecutive *common* dates, so they can't be prepared for each key alone.  Two plans give the same pairs:

* pairs_by_join - a self join on date, a window over each pair, an aggregate: n^2 d / 2 joined rows go through a shuffle, or, where
  blocks of keys meet (`joined`), through the sort of the task that joins them;
* pairs_by_block - keys are dealt into blocks, each pair of blocks meets in one task with both sides' series as arrays, and a
  numpy kernel correlates one key with some others at a time, over the dates that they share alone: a series is shuffled once for each
  block, not once for each pair and date.  What is wanted of a block's pairs (`gather`) is taken in that task, so where it is little, pairs
  aren't rows at all.

correlate() takes the second; the first is the plan to read, and the one that the tests hold the second against.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.series import CAPITAL
from heliograph.runtime import cut

#: Dates that two series must share, and returns that must be defined.
LEAST = 20
#: Keys in a block, at most and, where there are more tasks than pairs of blocks, at least: a block's series stay in the tens of megabytes.
BLOCK_KEYS, LEAST_KEYS = 4096, 16
#: Joined rows of two blocks of pairs_by_join, on average.
JOINED = 500_000
#: Keys of one and the same series that are dealt together: they meet others as one, and a block stays near its size.
COPIES = 64
#: Keys of a tile of a block: so many of the one side, by so many of the other.
TILE = 1024, 384


def pearson(x: Column, y: Column) -> Column:
    """Correlation in moment form: null, rather than an error, for constant input."""
    c = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))  # both of which skip nulls


def pairs_by_join(left: DataFrame, right: DataFrame | None = None, least: int = LEAST, capital: float = CAPITAL, joined: int | None = None) -> DataFrame:
    """(a, b, n, corr): pairs of keys a < b of one table of series, or a of the first and b of the second.

    With `joined` (one table alone: about so many rows for two blocks of keys, on average) keys are dealt into blocks, and all that joins, windows and aggregates two blocks is in one partition:
    series are shuffled once for each block, and joined rows not at all.
    """
    if joined is not None:
        met, by = _met_in_cells(left, joined), ["i", "j", "a", "b"]
        return _of_joined(met, by, least, capital).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "corr")
    one = left.select(F.col("key").alias("a"), "date", F.col("value").alias("x"))
    two = (left if right is None else right).select(F.col("key").alias("b"), "date", F.col("value").alias("y"))
    met = one.join(two, "date")
    if right is None:
        met = met.where("a < b")
    return _of_joined(met, ["a", "b"], least, capital)


def _met_in_cells(series: DataFrame, joined: int) -> DataFrame:
    """(i, j, date, a, x, b, y): rows of one date of two keys, each two keys in one cell of blocks i <= j, whose rows are in one partition."""
    series = cut(series.where("key IS NOT NULL AND date IS NOT NULL").select("key", "date", "value"))  # read once to count, and once to meet
    rows = series.groupBy("date").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
    blocks = max(1, int(np.ceil(np.sqrt(2 * rows / joined))))
    dealt = series.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    one = dealt.select(F.lit(True).alias("first"), F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"), "date", F.struct("key", "value").alias("of"))
    two = dealt.select(F.lit(False).alias("first"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), "date", F.struct("key", "value").alias("of"))
    side = lambda c: F.collect_list(F.when(c, F.col("of")))
    # a join of two tables would be shuffled by the date too
    met = one.unionByName(two).repartition(max(1, blocks * (blocks + 1) // 4), "i", "j").groupBy("i", "j", "date").agg(side(F.col("first")).alias("of_i"), side(~F.col("first")).alias("of_j"))
    met = met.select("i", "j", "date", F.explode("of_i").alias("p"), "of_j").select("i", "j", "date", "p", F.explode("of_j").alias("q"))
    return met.select("i", "j", "date", F.col("p.key").alias("a"), F.col("p.value").alias("x"), F.col("q.key").alias("b"), F.col("q.value").alias("y")).where("i < j OR a < b")


def _of_joined(met: DataFrame, by: list[str], least: int, capital: float) -> DataFrame:
    """(a, b, n, corr) of joined rows (a, b, date, x, y), by a and b and what else tells their place."""
    w = Window.partitionBy(*by).orderBy("date")
    r = lambda c: F.try_divide(F.col(c) - F.lag(c).over(w), F.lag(c).over(w) + capital)
    both = met.select(*by, r("x").alias("r"), r("y").alias("s"))
    out = both.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col("r").isNotNull() & F.col("s").isNotNull(), 1)).alias("m"), pearson(F.col("r"), F.col("s")).alias("corr"))
    return out.where((F.col("n") >= least) & (F.col("m") >= LEAST)).select("a", "b", F.col("m").alias("n"), "corr")


def common_returns(x: np.ndarray, there: np.ndarray, dates: np.ndarray, values: np.ndarray, edges: np.ndarray, capital: float) -> tuple:
    """(days, first, n, start, r, s, bad) of one series, on a dense calendar, with others, of which the i-th is dates and values edges[i] to edges[i + 1], by date.

    days: dates that each shares with it.  For those that share one (first: which), n returns between consecutive common dates are defined; they lie in r and s from `start` on.
    What isn't a return there (the first date's, and what `bad`, a mask or None, tells) is 0.
    """
    at = np.flatnonzero(there.take(dates, mode="wrap"))
    edge = np.searchsorted(at, edges)
    days = np.diff(edge)
    first = np.flatnonzero(days)
    start, n, bad = edge[first], days[first] - 1, None
    xs, ys = x.take(dates.take(at, mode="wrap"), mode="wrap"), values.take(at, mode="wrap")
    r, s = np.empty(len(at)), np.empty(len(at))
    if len(at):
        with np.errstate(all="ignore"):
            np.subtract(xs[1:], xs[:-1], out=r[1:])
            np.subtract(ys[1:], ys[:-1], out=s[1:])
            xs += capital
            ys += capital
            r[1:] /= xs[:-1]
            s[1:] /= ys[:-1]
            r[start] = s[start] = 0
            if not np.isfinite(r @ s):  # what isn't finite stays so in products with any number
                bad = ~(np.isfinite(r) & np.isfinite(s))
                n = n - np.add.reduceat(bad.astype(np.int64), start)
                r[bad] = s[bad] = 0
    return days, first, n, start, r, s, bad


def kernel(x: np.ndarray, there: np.ndarray, dates: np.ndarray, values: np.ndarray, edges: np.ndarray, least: int, capital: float) -> tuple[np.ndarray, np.ndarray]:
    """(returns or 0, correlation or nan) of one series with each of some others (see common_returns)."""
    days, first, m, start, r, s, bad = common_returns(x, there, dates, values, edges, capital)
    n, corr = np.zeros(len(days), np.int64), np.full(len(days), np.nan)
    if not len(first):
        return n, corr
    add = np.add.reduceat
    with np.errstate(all="ignore"):
        r1, s1, rr, ss, rs = add(r, start), add(s, start), add(r * r, start), add(s * s, start), add(r * s, start)
        r2, s2, both = rr - r1 * r1 / m, ss - s1 * s1 / m, rs - r1 * s1 / m
        if ((rr > 0) & (ss > 0) & (m > 1) & ((r2 < 1e-6 * rr) | (s2 < 1e-6 * ss))).any():  # the mean is most of a square: it is taken off first
            ok = np.ones(len(r), bool) if bad is None else ~bad
            ok[start] = False
            size = np.diff(np.append(start, len(r)))
            r, s = np.where(ok, r - np.repeat(r1 / m, size), 0.0), np.where(ok, s - np.repeat(s1 / m, size), 0.0)
            r2, s2, both = add(r * r, start), add(s * s, start), add(r * s, start)
        c = np.clip(both / np.sqrt(r2 * s2), -1, 1)
    n[first] = np.where((days[first] >= least) & (m >= LEAST), m, 0)
    corr[first] = np.where((r2 <= 1e-30 * m) | (s2 <= 1e-30 * m), np.nan, c)
    return n, corr


def moments(x: np.ndarray, there: np.ndarray, dates: np.ndarray, values: np.ndarray, edges: np.ndarray, capital: float) -> tuple[np.ndarray, np.ndarray]:
    """(days, sums) of one series with each of some others (see common_returns); sums are the number of returns, r, s, r * r, s * s and r * s."""
    days, first, m, start, r, s, _ = common_returns(x, there, dates, values, edges, capital)
    sums = np.zeros((6, len(days)))
    if len(first):
        q, add = np.empty_like(r), np.add.reduceat
        sums[0, first], sums[1, first], sums[2, first] = m, add(r, start), add(s, start)
        for at, (a, b) in enumerate(((r, r), (s, s), (r, s)), 3):
            sums[at, first] = add(np.multiply(a, b, out=q), start)
    return days, sums


def of_moments(days: np.ndarray, sums: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(returns or 0, correlation or nan, odd) of what moments() gives, as kernel() has them; where `odd`, the mean is most of a square, and kernel() must tell."""
    m, r1, s1, rr, ss, rs = sums
    with np.errstate(all="ignore"):
        r2, s2, both = rr - r1 * r1 / m, ss - s1 * s1 / m, rs - r1 * s1 / m
        odd = (rr > 0) & (ss > 0) & (m > 1) & ((r2 < 1e-6 * rr) | (s2 < 1e-6 * ss))
        corr = np.where((r2 > 1e-30 * m) & (s2 > 1e-30 * m), np.clip(both / np.sqrt(r2 * s2), -1, 1), np.nan)
    return np.where((days >= least) & (m >= LEAST), m, 0).astype(np.int64), corr, odd


@dataclass
class Block:
    """Series of one side of a block one after the other, by date; `at` are the places of their keys among all keys of the block, and `own` tells each key's series, in order."""

    at: np.ndarray
    own: np.ndarray
    dates: np.ndarray
    values: np.ndarray
    edges: np.ndarray

    @staticmethod
    def of(at: np.ndarray, own: np.ndarray, dates: np.ndarray, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> Block:
        size = last - first
        edges = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(edges[-1]) + np.repeat(first - edges[:-1], size)
        order = np.lexsort((dates[take], np.repeat(np.arange(len(first)), size)))
        return Block(at, own, dates[take][order].astype(np.intp), values[take][order], edges)

    def part(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(order, series, begin, end) of keys lo to hi: their order by place, the series of each in that order, and the range of all these."""
        order = lo + np.argsort(self.at[lo:hi])
        return order, self.own[order], int(self.own[lo]), int(self.own[hi - 1]) + 1


#: A tile: places of keys of the one side and of the other, and for each two of them a count, 0 where they are no pair, and each of the kernel's columns.
Tile = tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]


def as_pairs(columns: list[str]) -> Callable:
    """Every pair of a block as a row (a, b, *columns)."""

    def gather(keys: np.ndarray, tags: np.ndarray | None, tiles: Iterator[Tile], alone: bool) -> Iterator[dict]:
        for x, y, n, got in tiles:
            i, j = np.nonzero(n)
            a, b = x[i], y[j]
            if alone:
                a, b = np.minimum(a, b), np.maximum(a, b)  # places are in the order of keys
            yield {"a": keys[a], "b": keys[b], **{c: g[i, j] for c, g in zip(columns, got, strict=True)}}

    return gather


def packed(series: DataFrame) -> DataFrame:
    """(key, dates, values): each series as two arrays, without null values; what is packed stays so."""
    if "dates" in series.columns:
        return series
    return series.where("value IS NOT NULL AND NOT isnan(value)").groupBy("key").agg(F.collect_list(F.unix_date("date")).alias("dates"), F.collect_list("value").alias("values"))


def meet(left: DataFrame, right: DataFrame | None, kernel, columns: str, block_keys: int | None = None, gather: Callable | None = None, schema: str | None = None, tags: DataFrame | None = None, finish: Callable | None = None) -> DataFrame:
    """(a, b, *columns): what `kernel` says of pairs of keys a < b of one table of series, or a of the first and b of the second.

    kernel(x, there, dates, values, edges), of one series on a dense calendar with a mask of what is there, and some others as common_returns takes them, gives a count of which 0 is no pair,
    and an array for each of `columns` ("name type, ...").  Instead of all pairs, `gather(keys, tags, tiles, alone)` may take what is wanted of a block's tiles as rows of `schema`;
    keys are in order, and `key` in the schema stands for their type.  `tags` (key and doubles) go with the keys: an array, or a matrix of several, nan where there is none.
    With `finish` the kernel is moments(), and finish(days, sums) takes a whole tile's: a count, the columns, and which pairs are left to finish.again, a kernel.
    Null values are left out; keys are integers or strings.  Keys of one and the same series are one to the kernel, and shuffled as one.
    """
    spark = left.sparkSession
    kind = "string" if left.schema["key"].dataType.simpleString() == "string" else "long"
    names = [c.split()[0] for c in columns.split(",")]
    gather = gather or as_pairs(names)
    schema = ", ".join(" ".join([c.split()[0], kind if c.split()[1] == "key" else c.split()[1]]) for c in (schema or f"a key, b key, {columns}").split(","))
    arrow = pa.schema([(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(",")])
    tasks, alone = 2 * spark.sparkContext.defaultParallelism, right is None

    fields = [c for c in (tags.columns if tags is not None else []) if c != "key"]

    def dealt(df: DataFrame) -> tuple[DataFrame, int]:
        one = packed(df) if tags is None else packed(df).join(tags, "key", "left")
        own = F.struct("key", (F.array(*fields) if fields else F.lit(None).cast("array<double>")).alias("tag"))
        alike = one.select(own.alias("own"), F.sort_array(F.arrays_zip("dates", "values")).alias("series")).groupBy("series").agg(F.sort_array(F.collect_list("own")).alias("own"))
        few = F.transform(F.sequence(F.lit(0), F.floor((F.size("own") - 1) / COPIES).cast("int")), lambda i: F.slice("own", i * COPIES + 1, COPIES))
        one = cut(alike.select(F.explode(few).alias("own"), "series").select(F.col("own.key").alias("keys"), F.col("own.tag").alias("tags"), F.col("series.dates").alias("dates"), F.col("series.values").alias("values")))  # read once to count, and once for each side
        n = one.agg(F.sum(F.size("keys"))).first()[0] or 0
        blocks = -(-n // block_keys) if block_keys else max(-(-n // BLOCK_KEYS), min(-(-n // LEAST_KEYS), int(np.ceil(np.sqrt(2 * tasks)))))
        return one.withColumn("block", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(max(1, blocks))).cast("int")), max(1, blocks)

    one, n_one = dealt(left)
    two, n_two = (one, n_one) if alone else dealt(right)
    # each block of the left meets each block of the right, in a partition of its own
    side = lambda df, side, n, mine: df.select(F.lit(side).alias("side"), "keys", "tags", "dates", "values", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"), "block").select("side", "keys", "tags", "dates", "values", (F.col("block") if mine else F.col("other")).alias("i"), (F.col("other") if mine else F.col("block")).alias("j"))
    rows = side(one, 0, n_two, True).unionByName(side(two, 1, n_one, False))
    if alone:
        rows = rows.where("i <= j AND NOT (i = j AND side = 1)")
        cell, cells = F.expr("i * (2 * {0} - i - 1) div 2 + j".format(n_one)), n_one * (n_one + 1) // 2
    else:
        cell, cells = F.col("i") * n_two + F.col("j"), n_one * n_two
    met = rows.withColumn("same", F.lit(alone) & (F.col("i") == F.col("j"))).repartitionById(cells, cell.cast("int"))

    def tiles(ours: Block, theirs: Block, same: bool, days: int) -> Iterator[Tile]:
        x, there = np.zeros(days), np.zeros(days, bool)

        def one(ask: Callable, i: int, begin: int, top: int):
            span, base, end = slice(ours.edges[i], ours.edges[i + 1]), theirs.edges[begin], theirs.edges[top]
            x[ours.dates[span]], there[ours.dates[span]] = ours.values[span], True
            got = ask(x, there, theirs.dates[base:end], theirs.values[base:end], theirs.edges[begin : top + 1] - base)
            there[ours.dates[span]] = False
            return got

        for hi in range(0, len(theirs.at), TILE[1]):
            top = min(hi + TILE[1], len(theirs.at))
            second, q, low, high = theirs.part(hi, top)
            for lo in range(0, top if same else len(ours.at), TILE[0]):
                first, p, base, end = ours.part(lo, min(lo + TILE[0], top if same else len(ours.at)))
                begin = np.maximum(low, np.arange(base, end)) if same else np.full(end - base, low)
                n, got = np.zeros((end - base, high - low), np.int64), np.full((len(names) if finish is None else 6, end - base, high - low), np.nan)
                for k in range(end - base):
                    if begin[k] < high:
                        n[k, begin[k] - low :], *found = one(kernel, base + k, begin[k], high)
                        got[:, k, begin[k] - low :] = found if finish is None else found[0]
                if finish is not None:
                    n, got, odd = finish(n, got)
                    for k in np.flatnonzero(odd.any(1)):
                        at = np.flatnonzero(odd[k, begin[k] - low :])
                        _, *found = one(finish.again, base + k, begin[k], high)
                        for g, f in zip(got, found, strict=True):
                            g[k, begin[k] - low + at] = f[at]
                if not all(len(o) == width and (np.diff(o) > 0).all() for o, width in ((p, end - base), (q, high - low))):  # some have one and the same series
                    each = np.ix_(p - base, q - low)
                    n, got = n[each], [g[each] for g in got]
                yield ours.at[first], theirs.at[second], np.where(first[:, None] < second, n, 0) if same else n, list(got)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        sides, same = t["side"].to_numpy(), t["same"][0].as_py()
        flat = lambda c: [x.flatten() for x in t[c].chunks]
        many, size = (np.concatenate([np.diff(x.offsets.to_numpy()) for x in t[c].chunks]) for c in ("keys", "dates"))
        keys = np.array([k for x in flat("keys") for k in x.to_pylist()], object if kind == "string" else np.int64)
        dates, values = (np.concatenate([x.to_numpy(zero_copy_only=False) for x in flat(c)]) for c in ("dates", "values"))
        tag = np.array([[np.nan if v is None else v for v in row] for x in flat("tags") for row in x.to_pylist()], float) if fields else None
        del t, batches
        calendar, dates = np.unique(dates, return_inverse=True)
        order = np.argsort(keys, kind="stable")
        place, last, upto, parts = np.empty(len(keys), np.int64), np.cumsum(size), np.cumsum(many), []
        place[order] = np.arange(len(keys))
        for of in (0, 1):
            rows = np.flatnonzero(sides == of)
            rows = rows[np.argsort(place[upto[rows] - many[rows]])]
            own = np.repeat(np.arange(len(rows)), many[rows])
            at = np.arange(len(own)) + np.repeat(upto[rows] - np.cumsum(many[rows]), many[rows])
            parts.append(Block.of(place[at], own, dates, values, last[rows] - size[rows], last[rows]))
        keys, tag = keys[order], tag[order] if fields else None
        for out in gather(keys, tag if len(fields) != 1 else tag[:, 0], tiles(parts[0], parts[0] if same else parts[1], same, len(calendar)), alone):
            got = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type, from_pandas=True) for f in arrow], schema=arrow)
            if len(got):
                yield got

    return met.select("side", "same", "keys", "tags", "dates", "values").mapInArrow(blocks, schema)


def pairs_by_block(left: DataFrame, right: DataFrame | None = None, least: int = LEAST, capital: float = CAPITAL, block_keys: int | None = None) -> DataFrame:
    """The same as pairs_by_join. Null values are left out; keys are integers or strings."""

    return correlated(left, right, least, capital, block_keys)


def correlated(left: DataFrame, right: DataFrame | None = None, least: int = LEAST, capital: float = CAPITAL, block_keys: int | None = None, gather: Callable | None = None, schema: str | None = None, tags: DataFrame | None = None) -> DataFrame:
    """What `gather` takes of the correlations of a block's pairs (see meet), as rows of `schema`; all pairs (a, b, n, corr) without it."""

    def again(x, there, dates, values, edges):
        n, corr = kernel(x, there, dates, values, edges, least, capital)
        return n, n, corr

    def finish(days, sums):
        n, corr, odd = of_moments(days, sums, least)
        return n, [n, corr], odd

    finish.again = again
    return meet(left, right, lambda *series: moments(*series, capital), "n long, corr double", block_keys, gather, schema, tags, finish)


correlate = pairs_by_block


def mirrored(pairs: DataFrame) -> DataFrame:
    """(key, partner, corr): every pair from both ends."""
    return pairs.select(F.col("a").alias("key"), F.col("b").alias("partner"), "corr").unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("partner"), "corr"))


def summary(pairs: DataFrame) -> DataFrame:
    """(key, min, max, avg and median correlation) over all partners that a correlation is defined with."""
    return mirrored(pairs).where("corr IS NOT NULL").groupBy("key").agg(F.min("corr").alias("min_correlation"), F.max("corr").alias("max_correlation"), F.avg("corr").alias("avg_correlation"), F.median("corr").alias("median_correlation"))


def best_match(pairs: DataFrame) -> DataFrame:
    """(key, max_correlation, best_match): for each a the greatest absolute correlation and its b, the least of equals."""
    return pairs.where("corr IS NOT NULL").groupBy(F.col("a").alias("key")).agg(F.max(F.abs("corr")).alias("max_correlation"), F.min_by("b", F.struct(-F.abs("corr"), "b")).alias("best_match"))


def positive_max(pairs: DataFrame) -> DataFrame:
    """(key, correlation): the greatest correlation with any partner, 0 at least."""
    return mirrored(pairs).groupBy("key").agg(F.greatest(F.max("corr"), F.lit(0.0)).alias("correlation"))


def with_reference(series: DataFrame, reference, least: int = LEAST, positive: bool = True) -> DataFrame:
    """(key, correlation) of every key with one; signed, or only what is positive.  Whether the one series is broadcast by date is left to its measured size."""
    ref = series.where(F.col("key") == reference)
    pairs = pairs_by_join(series.where(F.col("key") != reference), ref, least)
    corr = F.greatest(F.col("corr"), F.lit(0.0)) if positive else F.col("corr")
    return pairs.select(F.col("a").alias("key"), corr.alias("correlation")).where("correlation IS NOT NULL")


def rolling_medians(r: np.ndarray, s: np.ndarray, n: np.ndarray, windows: tuple[int, ...], least: int) -> np.ndarray:
    """Of rows of n[i] returns, padded: for each width (a column) the median of the correlations of windows of width - 1 returns, 0 where there is none."""
    there = np.arange(r.shape[1]) < n[:, None]
    r, s = (np.where(there, t - (t.sum(1) / np.maximum(n, 1))[:, None], 0.0) for t in (r, s))  # which changes no correlation, and keeps running sums small
    sums = [np.concatenate([np.zeros((len(n), 1)), np.cumsum(t, 1)], 1) for t in (r, s, r * r, s * s, r * s)]
    out = np.zeros((len(n), len(windows)))
    for at, width in enumerate(windows):
        m = width - 1
        rows = np.flatnonzero(n >= max(m, least, 2))
        if not len(rows):
            continue
        a, b, aa, bb, ab = (t[rows, m:] - t[rows, :-m] for t in sums)
        x2, y2 = aa - a * a / m, bb - b * b / m
        ok = (x2 > 0) & (y2 > 0) & there[rows, m - 1 :]
        with np.errstate(all="ignore"):
            corr = np.sort(np.where(ok, (ab - a * b / m) / np.sqrt(x2 * y2), np.inf), 1)
        many, row = ok.sum(1), np.arange(len(rows))
        out[rows, at] = np.where(many > 0, (corr[row, np.maximum(many - 1, 0) // 2] + corr[row, np.minimum(many // 2, corr.shape[1] - 1)]) / 2, 0.0)
    return out


def rolling(left: DataFrame, windows: tuple[int, ...] = (60, 120, 252), least: int = 30, capital: float = CAPITAL) -> DataFrame:
    """(a, b, corr): for each window width the median of the rolling correlation, averaged with weights 1, 1/2, 1/3 ...; missing ones count as 0.

    Pairs that share no two returns have no row.  Series meet in blocks, as in pairs_by_block; windows are differences of running sums, so a row costs the same for every width.
    """
    weights = np.array([1 / (i + 1) for i in range(len(windows))])
    weights /= weights.sum()

    def averaged(x, there, dates, values, edges):
        days, first, n, start, r, s, bad = common_returns(x, there, dates, values, edges, capital)
        count, corr = np.zeros(len(days), np.int64), np.zeros(len(days))
        if len(first):
            count[first] = n
            size = np.diff(np.append(start, len(r)))
            ok = np.ones(len(r), bool) if bad is None else ~bad
            ok[start] = False
            # pairs of about as many returns are worked on together, so that few that share many dates don't widen the rows of all; shorter ones have no window
            kind = np.where(n >= max(min(windows) - 1, least, 2), np.log(np.maximum(n, 1)) // np.log(1.15), -1)
            for k in np.unique(kind[kind >= 0]):
                some = np.flatnonzero(kind == k)
                m = n[some]
                at = np.repeat(start[some], size[some]) + np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
                at = at[ok[at]]
                wide = np.zeros((2, len(some), int(m.max())))
                wide[:, np.repeat(np.arange(len(some)), m), np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)] = r[at], s[at]
                corr[first[some]] = rolling_medians(*wide, m, windows, least) @ weights
        return count, corr

    return meet(left, None, averaged, "corr double")


def noise_threshold(series: DataFrame, multiplier: float = 2.5, cap: float = 0.95) -> DataFrame:
    """(threshold): multiplier * sqrt(ln(keys) / mean length), capped."""
    n = series.groupBy("key").agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.floor(F.avg("n")).alias("length"))
    return n.select(F.least(F.lit(cap), multiplier * F.sqrt(F.log("keys") / F.col("length"))).alias("threshold"))


def thresholded(pairs: DataFrame, threshold: DataFrame) -> DataFrame:
    """pairs with correlations that don't exceed the threshold set to 0."""
    return pairs.crossJoin(F.broadcast(threshold)).withColumn("corr", F.when(F.abs("corr") > F.col("threshold"), F.col("corr")).otherwise(0.0)).drop("threshold")


def shrunk(pairs: DataFrame, by: float = 0.1) -> DataFrame:
    """Off-diagonal correlations shrunk towards 0; the diagonal, which isn't stored, stays 1."""
    return pairs.withColumn("corr", F.col("corr") * (1 - by))


def distance(corr: Column, kind: str = "euclidean") -> Column:
    if kind == "euclidean":
        return F.sqrt(2 * (1 - corr))
    if kind == "angular":
        return F.sqrt((1 - corr) / 2)
    return 1 - corr
