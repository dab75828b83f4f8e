"""Operator 8: near-duplicate documents by MinHash and an LSH forest.

A document's shingles are its runs of SHINGLE words, its signature TREES * DEPTH minima of hashed shingles, one byte each.
Documents of equal signatures are one node (a hash aggregation, so thousands of copies cost one row).
Nodes enter a forest: tree t sorts them by bytes [t * DEPTH, (t + 1) * DEPTH) of the signature.  Nodes that share LEAST_DEPTH bytes make a
region of a tree's order, and the neighbours of a node in it, longest common prefix first, are its candidates:

 1. The NEAR nodes to each side are compared at once, by the share of equal signature bytes.  Where a region is sparse, this goes up to
    its root, at depth LEAST_DEPTH; where it is crowded, its neighbours share a longer prefix, so the depth adapts to the region.
 2. What is left of a region larger than that is explored group by group: each node of a group is compared with all nodes of the
    region that aren't in the group yet, so the groups are those of all pairs, whatever the region's size.  Alike documents cost little;
    a crowd of documents that aren't alike takes time with the square of its size.
 3. Regions of more than CROWD nodes are dealt into blocks; each pair of blocks is a task's region of its own, so none is held whole.

Pairs that reach the threshold become edges, a spanning set for each region, and connected components (alternating large-star and small-star steps,
hash aggregations of Spark) are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import cut, free, lean, light_batches, parted, table, written
from heliograph.llm.textnum import chunks, hashed_words, mix64, windows

SHINGLE = 3
TREES, DEPTH = 16, 8
#: Bytes that two nodes must share in a tree's order to be candidates: a parameter of recall, the same at every size.
LEAST_DEPTH = 3
#: Nodes that are compared in one numpy pass of an exploration, and documents of a pass, at most.
PASS_PAIRS, PASS_ROWS = 1 << 22, 256
#: Neighbours to each side that are compared at once; a matter of speed alone.
NEAR = 24
#: Nodes of a region that one task holds; larger regions are dealt into blocks. At most CROWDED regions are told apart from others by a broadcast (8 bytes each),
#: so the least number of nodes grows where there could be more.  A matter of distribution alone.
CROWD, CROWDED = 20_000, 100_000
#: Jaccard similarity of the shingle sets from which two documents count as near duplicates.
THRESHOLD = 0.5

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, first shingle of each document that has any, those documents); a text under SHINGLE words is one shingle."""
    hashes, _, _, first = hashed_words(data, offs)
    n_words = np.diff(first)
    own = windows(hashes, SHINGLE)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    ok = doc[: len(own)] == doc[SHINGLE - 1 :] if len(own) else np.zeros(0, bool)
    own, own_doc = own[ok], doc[: len(ok)][ok]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        whole = hashes[first[short]].copy()
        for j in range(1, SHINGLE - 1):
            more = n_words[short] > j
            whole[more] = mix64(whole[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[first[short][more] + j])
        own, own_doc = np.concatenate([own, whole]), np.concatenate([own_doc, short])
        order = np.argsort(own_doc, kind="stable")
        own, own_doc = own[order], own_doc[order]
    head = np.flatnonzero(np.r_[True, own_doc[1:] != own_doc[:-1]]) if len(own_doc) else np.zeros(0, np.int64)
    return own, head, own_doc[head]


def signatures(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have words, their signatures: a row of TREES * DEPTH bytes each)."""
    own, head, docs = shingles(data, offs)
    out = np.empty((len(docs), TREES * DEPTH), np.uint8)
    if len(docs):
        x = (own >> np.uint64(32)).astype(np.uint32)
        v = np.empty_like(x)
        for k in range(TREES * DEPTH):
            np.multiply(x, _A[k], out=v)
            v += _B[k]
            low = np.minimum.reduceat(v, head)
            low ^= low >> np.uint32(15)
            low *= np.uint32(0x2C1B3C6D)
            out[:, k] = low >> np.uint32(24)
    return docs, out


def similarity(equal: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal signature bytes, less what agrees by chance."""
    return (equal * 256.0 - 1.0) / 255.0


_LEAST_EQUAL = int(np.ceil((THRESHOLD * 255 + 1) / 256 * TREES * DEPTH))


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each index's component."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _equal(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Equal bytes of each row of rows and each column of columns."""
    out = np.zeros((len(rows), columns.shape[1]), np.uint8)
    for k in range(len(columns)):
        out += rows[:, k, None] == columns[k]
    return out


def _neighbour_pairs(sig: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, up to NEAR apart in a tree's order and both before the end of the first one's region, that agree in _LEAST_EQUAL bytes."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.arange(len(sig))
    for d in range(1, NEAR + 1):
        at = at[at + d < end[at]]
        for i in range(0, len(at), 1 << 16):
            x = at[i : i + (1 << 16)]
            x = x[(sig[x] == sig[x + d]).sum(1) >= _LEAST_EQUAL]
            left.append(x)
            right.append(x + d)
    return np.concatenate(left), np.concatenate(right)


def _group_pairs(sig: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of sig that agree in _LEAST_EQUAL bytes, as many as it takes, with those that made `group`, to join the groups of all such pairs.

    A group is finished before the next begins: each of its rows is compared with all rows that are in no finished group and not in its own.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size_of = np.bincount(group, minlength=len(sig))
    rest = np.lexsort((np.arange(len(sig)), group, size_of[group] < 2))  # groups of several rows first
    columns = np.ascontiguousarray(sig[rest].T)

    def keep(mask: np.ndarray) -> None:
        nonlocal rest, columns
        rest, columns = rest[mask], np.ascontiguousarray(columns[:, mask])

    def explore(rows: np.ndarray) -> None:
        """Takes everything that is linked with rows, which are in rest no more, out of it."""
        todo = [rows]
        while todo and len(rest):
            size, rows = min(PASS_ROWS, max(1, PASS_PAIRS // len(rest))), todo.pop()
            if len(rows) > size:
                todo.append(rows[size:])
                rows = rows[:size]
            near = _equal(sig[rows], columns) >= _LEAST_EQUAL
            found = near.any(0)
            if found.any():
                left.append(rows[near[:, found].argmax(0)])
                right.append(rest[found])
                whole = np.isin(group[rest], group[rest[found]])  # with the groups that they belong to
                todo.append(rest[whole])
                keep(~whole)

    while len(rest) and size_of[group[rest[0]]] > 1:
        own = group[rest] == group[rest[0]]
        rows = rest[own]
        keep(~own)
        explore(rows)
    seeds = 1
    while len(rest) > 1:
        size = min(seeds, PASS_ROWS, max(1, PASS_PAIRS // len(rest)))
        near = _equal(sig[rest[:size]], columns) >= _LEAST_EQUAL
        near[np.arange(len(near)), np.arange(len(near))] = False
        linked = np.flatnonzero(near.any(1))
        if not len(linked):  # rows that are close to none of the rest are groups of their own
            keep(np.arange(len(rest)) >= size)
            seeds = size * 2
            continue
        row, seeds = rest[linked[0]], 1
        keep(np.arange(len(rest)) > linked[0])
        explore(np.array([row]))
    return np.concatenate(left), np.concatenate(right)


def region_edges(nodes: np.ndarray, sig: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) among rows that come sorted by region and a tree's order; end: where the region of each row ends."""
    a, b = _neighbour_pairs(sig, end)
    group = _components(len(nodes), a, b)
    begin = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else np.zeros(0, np.int64)
    for lo, hi in zip(begin, end[begin], strict=True):
        if hi - lo > NEAR + 1 and (group[lo:hi] != group[lo]).any():
            x, y = _group_pairs(sig[lo:hi], group[lo:hi] - lo)
            a, b = np.concatenate([a, x + lo]), np.concatenate([b, y + lo])
    by_node = np.argsort(nodes, kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[by_node] = np.arange(len(nodes))
    low = _components(len(nodes), place[a], place[b])
    linked = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[by_node][linked], nodes[by_node][low[linked]]


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sig) of the rows that have words; rows of equal doc_id and text have one key."""
    light_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(2)):
                docs, sig = signatures(data, offs)
                if len(docs):
                    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(sig.shape[1]), len(docs), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo).take(pa.array(docs)) for i in (0, 1)), flat], ["doc_id", "key", "sig"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")
    return slim.mapInArrow(lean(run), "doc_id long, key long, sig binary")


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _forest_edges(batches):
    """Edges of regions; rows come sorted by region, and a region may span batches."""

    def solve(rows: pa.Table):
        part, nodes = rows["part"].to_numpy(), rows["node"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(len(nodes), -1)
        cuts = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        a, b = region_edges(nodes, sig, np.repeat(cuts, np.diff(cuts, prepend=0)))
        edges = np.unique(np.stack([a, b], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    keep, held = [], 0
    for batch in batches:
        keep.append(batch)
        held += batch.num_rows
        if held >= CROWD:
            rows = pa.Table.from_batches(keep)
            part = rows["part"].to_numpy()
            last = int(np.searchsorted(part, part[-1]))
            if last:
                yield from solve(rows.slice(0, last))
                rows = rows.slice(last)
            keep, held = rows.combine_chunks().to_batches(), len(rows)
    if held:
        yield from solve(pa.Table.from_batches(keep))


def forest_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of a stored table (node, sig), by the forest.

    Regions are counted first: a signature goes to those of its regions that have another node (a filter of bits tells, see parted()), so
    in a sparse forest most of a node's trees cost it the 8 bytes of a region and no more.
    """
    region = F.posexplode(F.array(*[F.xxhash64(F.lit(t), F.substring("sig", t * DEPTH + 1, LEAST_DEPTH)) for t in range(TREES)]))
    rows = nodes.select("node", "sig", region.alias("tree", "region"))
    shared = written(rows.groupBy("region").count().where("count > 1"), "regions")
    least = max(CROWD, nodes.count() * TREES // CROWDED)
    some = shared.where(F.col("count") > least).select("region", F.ceil(F.col("count") / least).cast("int").alias("blocks")).collect()  # CROWDED rows, at most
    rows, _ = parted(rows, F.col("region"), shared.select("region"))
    if some:
        rows = rows.join(F.broadcast(nodes.sparkSession.createDataFrame(some, "region long, blocks int")), "region", "left")
        own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(own))))
        rows = rows.select("node", "sig", "tree", "region", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
        part = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
    else:
        part = F.col("region")
    # a tree's own bytes come first, so that its order is the order of signatures; all of a region are turned alike
    turned = F.expr(f"concat(substring(sig, tree * {DEPTH} + 1), substring(sig, 1, tree * {DEPTH}))")
    placed = rows.select(part.alias("part"), "node", turned.alias("sig")).repartition("part").sortWithinPartitions("part", "sig", "node")
    return placed.mapInArrow(lean(_forest_edges), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id that an edge (a, b) names, the root the least id of its connected component.

    Large-star and small-star steps alternate until no edge changes; each step is an aggregation by node whose result
    is kept in the shared folder, so rounds don't pile up lineage.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        now = cut(small)
        mark = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if mark == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = mark


def grouped(docs: DataFrame) -> DataFrame:
    """One row (key, doc_id, n, kept_key, kept_id, group_size) for each distinct document in a group of several, or in several rows: n of them.

    kept_key and kept_id tell the group's document of the least doc_id (null ones last, of one id the least key).
    """
    rows = written(signed(docs).withColumn("node", F.xxhash64("sig")), "signatures")
    nodes = written(rows.select("node", "sig").distinct(), "nodes")
    roots = components(forest_edges(nodes))
    own = rows.groupBy("node", "doc_id", "key").agg(F.count("*").alias("n"))
    own = own.join(roots, own.node == roots.id, "left").select("doc_id", "key", "n", F.coalesce("root", "node").alias("class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
    classes = own.groupBy("class").agg(first.alias("kept"), F.count("*").alias("group_size"), F.max("n").alias("most")).where("group_size > 1 or most > 1")
    return own.join(classes, "class").select("key", "doc_id", "n", F.col("kept.key").alias("kept_key"), F.col("kept.doc_id").alias("kept_id"), "group_size").where("group_size > 1 or n > 1")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row (doc_id, kept_id, group_size) for each document that goes: it is in the group of kept_id, the least doc_id of the group.

    Groups are the connected components of pairs whose shingle sets have an estimated Jaccard similarity of THRESHOLD or more.
    Documents are told by doc_id and text, so texts that share a doc_id are documents of their own, and rows without a doc_id are too; they come
    last where one of a group is kept.  A kept document that repeats in equal rows has one row with kept_id = doc_id.  Texts that are null or
    have no words are in no group.  group_size counts the distinct documents of a group.  Other columns are ignored.
    """
    return grouped(docs).where("key != kept_key or n > 1").select("doc_id", "kept_id", "group_size")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates, the one of the least doc_id (null ones last); of its equal rows one stays.

    Texts without words are kept.  Columns are those of docs.
    """
    found = written(grouped(docs).where("key != kept_key or n > 1").select("key", (F.col("key") == F.col("kept_key")).alias("stays")), "near-duplicates")
    some, rest = parted(docs, _key(), found.select("key"))
    gone, again = free(docs, "_near_key"), free(docs, "_near_repeated")
    marked = some.join(found.select(F.col("key").alias(gone), F.col("stays").alias(again)), _key() == F.col(gone), "left")
    alone = marked.where(F.col(gone).isNull()).select(*docs.columns)
    repeated = marked.where(F.col(again)).dropDuplicates([gone]).select(*docs.columns)
    return rest.unionByName(alone).unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
