"""Operator 1: exact substring deduplication with prefix-partitioned suffix trees.

Texts are sequences of words; a repeat is a run of MIN_WORDS or more words that occurs twice, in one document or in two.
Building a tree over every suffix of the corpus would shuffle the corpus many times over.  These trees are sparse,
and exact all the same: every window of MIN_WORDS words has an anchor, the least hashed run of PREFIX words in it, which
depends on the window's words alone, so equal windows have equal anchors at equal offsets.  Only suffixes that
start at anchors are sorted (about one in eighteen), each with the words that its windows reach to the left and right.

 1. Prefixes: the PREFIX words of every anchor are counted over the corpus.  Those that occur once start no repeat; the
    others go to the executors as a bitmap of at most BITMAP_BITS bits, whatever their number (a bit set by chance costs
    a shuffled row, never a result).
 2. Partition: suffixes whose prefix repeats are shuffled and sorted by prefix.  Prefixes are of variable length, so that each group of
    suffixes fits memory (PACK suffixes; groups are packed together up to that): the windows that begin lo to hi words
    before an anchor have MIN_WORDS - hi + lo words in common, from lo words before it on; where too many suffixes share
    those, the windows are parted in two, lo to the middle and the rest, which share about half as many words more each.  Prefixes
    grow so from PREFIX words up to whole windows.  Windows that are too many even so are all alike: they need no tree, only a count
    and the oldest of them, and aren't shuffled by prefix at all.
 3. Trees: a group's suffixes are sorted word by word; common prefixes of neighbours give the internal nodes,
    a node at depth d being a run of suffixes that share d words.  A second tree, over the words leftwards, does the same for
    what precedes.  A window that starts o words before its anchor is repeated exactly where suffixes meet in one node of depth
    MIN_WORDS - o of the first tree and one of depth o of the second.
 4. Repeats: windows of one document that overlap or touch are joined to maximal repeated passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import free, lean, light_batches, parted, table, written
from heliograph.llm.decontamination import WORDS_SQL
from heliograph.llm.textnum import chunks, hashed_words, mix64, windows, words

#: Words of the shortest repeat.
MIN_WORDS = 50
#: Words of the shortest prefix that suffixes are partitioned by.
PREFIX = 16
#: Suffixes that are sorted at once. Prefixes of more are made longer; where more than LONGER prefixes would be (a bound of what is broadcast), only those
#: of twice as many suffixes, and so on.  A matter of memory alone.
PACK, LONGER = 60_000, 1 << 20
BITMAP_BITS = 1 << 29

_REACH = MIN_WORDS - PREFIX
_AROUND = np.concatenate([np.arange(-1, -_REACH - 1, -1), np.arange(PREFIX, MIN_WORDS)])  # leftwards, then rightwards


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash, word index, least and greatest offset of its windows) of each anchor of a chunk's documents."""
    none = (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    if len(h) < MIN_WORDS:
        return none
    prefix = windows(h, PREFIX)
    low = (prefix & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(prefix), dtype=np.uint64)
    width, want = 1, _REACH + 1
    while width < want:  # least of `width` entries from each place on, doubled until it spans a window
        step = min(width, want - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    n_words = np.diff(first)
    n_windows = np.maximum(n_words - MIN_WORDS + 1, 0)
    doc = np.repeat(np.arange(len(n_words)), n_windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + first[doc]
    if not len(at):
        return none
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.append(head[1:], len(anchor)) - 1
    place = anchor[head]
    return prefix[place], place, place - at[last], place - at[head]


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): rows of equal doc_id and text have one key."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return slim.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


class Prefixes:
    """What executors know of the prefixes of a corpus: those that may repeat, and those of too many suffixes."""

    def __init__(self, bits: int, bitmap: np.ndarray, crowded: np.ndarray):
        self.bits, self.bitmap, self.crowded = bits, bitmap, crowded

    def repeated(self, g: np.ndarray) -> np.ndarray:
        at = (g >> np.uint64(64 - self.bits)).astype(np.int64)
        return np.flatnonzero(self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)

    def descend(self, h: np.ndarray, g: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, every: bool = False) -> tuple[np.ndarray, ...]:
        """(suffix, prefix hash, least and greatest offset of its windows, whether it is a whole window of a crowded prefix), prefixes made longer while they are crowded.

        every: gives all longer prefixes of the crowded ones instead.
        """
        who, lo, hi, out = np.arange(len(g)), np.zeros(len(g), np.int64), np.full(len(g), _REACH), []
        while len(who):
            many = self._crowded(g) if not every or not out else np.ones(len(g), bool)
            full = many & (lo == hi)
            done = ~many | full
            if not every:
                out.append((who[done], g[done], lo[done], hi[done], full[done]))
            elif out:
                out.append((who, g, lo, hi, full))
            else:
                out.append(tuple(x[:0] for x in (who, g, lo, hi, full)))
            who, lo, hi = who[~done], lo[~done], hi[~done]
            middle = (lo + hi) // 2
            who, lo, hi = np.concatenate([who, who]), np.concatenate([lo, middle + 1]), np.concatenate([middle, hi])
            some = (lo <= high[who]) & (low[who] <= hi)  # has windows there
            who, lo, hi = who[some], lo[some], hi[some]
            g = _span_hash(h, place[who] - lo, lo, hi)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (who, g, lo, hi, np.zeros(0, bool))

    def _crowded(self, g: np.ndarray) -> np.ndarray:
        if not len(self.crowded):
            return np.zeros(len(g), bool)
        return self.crowded[np.minimum(np.searchsorted(self.crowded, g), len(self.crowded) - 1)] == g


def _span_hash(h: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words that windows lo to hi words before an anchor have in common; start is where the one at lo begins."""
    out = (lo * 64 + hi + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    length = MIN_WORDS - hi + lo
    for j in range(int(length.max()) if len(length) else 0):
        more = length > j
        out[more] = mix64(out[more]) + h[start[more] + j]
    return mix64(out)


def _anchored(prefixes: Prefixes, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word hashes, first words of documents, and of the suffixes whose prefix may repeat: prefix hash, place, least and greatest offset)."""
    h, _, _, first = hashed_words(data, offs)
    g, place, low, high = anchors(h, first)
    some = prefixes.repeated(g)
    return h, first, g[some], place[some], low[some], high[some]


def _most_crowded(counted: DataFrame) -> DataFrame:
    """Rows of a stored table (g, n, …) with n over PACK, LONGER of them at most."""
    most = PACK
    while (found := counted.where(F.col("n") > most)).count() > LONGER:
        most *= 2
    return found


def _prefixes(docs: DataFrame) -> tuple[Prefixes, np.ndarray]:
    """The prefixes of a corpus, and the hashes of the whole windows among the crowded ones."""
    spark = docs.sparkSession
    slim = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")

    def run(batches):
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                h, _, _, first = hashed_words(data, offs)
                g, n = np.unique(anchors(h, first)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])

    counted = slim.mapInArrow(lean(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    repeated = written(counted.where("n > 1"), "repeated-prefixes")
    bits = int(np.clip(int(max(repeated.count(), 1) * 64 - 1).bit_length(), _ROW_BITS, BITMAP_BITS.bit_length() - 1))
    row = repeated.select(F.shiftrightunsigned("g", 64 - bits).alias("at")).groupBy(F.shiftright("at", _ROW_BITS).alias("row"))
    bitmap = np.zeros((1 << (bits - _ROW_BITS), 1 << (_ROW_BITS - 3)), np.uint8)
    for r in row.agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias("bits")).collect():
        bitmap[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    as_hashes = lambda table: np.sort(table.select("g").toArrow()["g"].to_numpy().view(np.uint64))
    prefixes = Prefixes(bits, bitmap.ravel(), as_hashes(_most_crowded(repeated)))
    if not len(prefixes.crowded):
        return prefixes, prefixes.crowded
    sent = spark.sparkContext.broadcast(prefixes)

    def longer(batches):
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                h, _, g, place, low, high = _anchored(sent.value, data, offs)
                _, g, _, _, full = sent.value.descend(h, g, place, low, high, every=True)
                g, at, n = np.unique(g, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(full[at]), pa.array(n)], ["g", "whole", "n"])

    found = slim.mapInArrow(lean(longer), "g long, whole boolean, n long").groupBy("g", "whole").agg(F.sum("n").alias("n")).where(F.col("n") > PACK)
    found = _most_crowded(written(found, "crowded-prefixes"))
    whole = as_hashes(found.where("whole"))
    return Prefixes(bits, prefixes.bitmap, np.union1d(prefixes.crowded, as_hashes(found))), whole


_ROW_BITS = 15  # of the bitmaps that Spark makes
_SUFFIXES = "g long, key long, doc_id long, place int, low byte, high byte, around binary"
_WINDOWS = "g long, key long, doc_id long, place int"
_RUNS = "key long, doc_id long, start_word int, end_word int, kept boolean, copies long"


def _suffixes(docs: DataFrame, prefixes: Prefixes) -> DataFrame:
    """Suffixes at anchors whose prefix may repeat, with the words around."""
    sent = docs.sparkSession.sparkContext.broadcast(prefixes)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(2)):
                h, first, g, place, low, high = _anchored(sent.value, data, offs)
                who, g, least, most, whole = sent.value.descend(h, g, place, low, high)
                who, g, least, most = who[~whole], g[~whole], least[~whole], most[~whole]
                if not len(who):
                    continue
                place, low, high = place[who], np.maximum(low[who], least), np.minimum(high[who], most)
                doc = np.searchsorted(first, place, side="right") - 1
                at = place[:, None] + _AROUND
                inside = (at >= first[doc, None]) & (at < first[doc + 1, None])
                short = (h >> np.uint64(32)).astype(np.uint32)
                around = np.where(inside, short[np.clip(at, 0, len(h) - 1)], 0).astype(">u4")
                rows = pa.array(doc)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * around.shape[1]), len(around), [None, pa.py_buffer(np.ascontiguousarray(around))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), batch.column(0).slice(lo, hi - lo).take(rows), batch.column(1).slice(lo, hi - lo).take(rows), pa.array((place - first[doc]).astype(np.int32)), pa.array(low.astype(np.int8)), pa.array(high.astype(np.int8)), flat],
                    ["g", "key", "doc_id", "place", "low", "high", "around"],
                )

    return _keyed(docs).mapInArrow(lean(run), _SUFFIXES)


def _crowded_windows(docs: DataFrame, prefixes: Prefixes) -> DataFrame:
    """Repeats of one window each, of those windows that occur too often for a tree: they are all alike, so their number and the oldest tell all."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(prefixes)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(2)):
                h, first, g, place, low, high = _anchored(sent.value, data, offs)
                who, g, offset, _, whole = sent.value.descend(h, g, place, low, high)
                who, g, offset = who[whole], g[whole], offset[whole]
                if len(who):
                    doc = np.searchsorted(first, place[who], side="right") - 1
                    at = (place[who] - offset - first[doc]).astype(np.int32)
                    rows = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), *(batch.column(i).slice(lo, hi - lo).take(rows) for i in (0, 1)), pa.array(at)], ["g", "key", "doc_id", "place"])

    rows = written(_keyed(docs).mapInArrow(lean(run), _WINDOWS), "windows-of-crowded-prefixes")
    oldest = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "place")).alias("oldest")
    known = rows.distinct().groupBy("g").agg(F.count("*").alias("copies"), oldest).where("copies > 1")
    known = written(known.select("g", "copies", F.col("oldest.key").alias("first_key"), F.col("oldest.place").alias("first_place")), "crowded-windows")
    out = rows.join(F.broadcast(known), "g")  # LONGER rows at most
    kept = (F.col("key") == F.col("first_key")) & (F.col("place") == F.col("first_place"))
    return out.select("key", "doc_id", F.col("place").alias("start_word"), (F.col("place") + MIN_WORDS).alias("end_word"), kept.alias("kept"), "copies")


class SuffixTree:
    """Internal nodes of the compressed tree of rows of words, below the roots that `group` tells apart."""

    def __init__(self, group: np.ndarray, rows: np.ndarray):
        n, self.depth = rows.shape
        keyed = np.empty((n, self.depth + 1), ">u4")
        keyed[:, 0], keyed[:, 1:] = group, rows
        self.order = np.argsort(keyed.view(f"V{keyed.dtype.itemsize * keyed.shape[1]}").ravel())
        ordered = keyed[self.order]
        differ = np.ones((n, self.depth + 2), bool)
        differ[1:, :-1] = ordered[1:] != ordered[:-1]
        differ[0, 0] = True
        #: Words that each suffix shares with the one before it in order; -1 across roots.
        self.common = differ.argmax(1) - 1

    def nodes(self, depth: int) -> np.ndarray:
        """For each row the node at this depth: equal for rows that share so many words."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def repeats(g: np.ndarray, key: np.ndarray, doc_id: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start word, end word, kept, copies) of the runs of repeated windows of suffixes sorted by prefix.

    kept tells the first occurrence of a window, by doc_id, key and place, from the others.
    """
    group = np.cumsum(np.r_[True, g[1:] != g[:-1]])
    by_age = np.lexsort((group, place, key, doc_id))
    same = np.r_[False, (group[by_age][1:] == group[by_age][:-1]) & (place[by_age][1:] == place[by_age][:-1]) & (key[by_age][1:] == key[by_age][:-1]) & (doc_id[by_age][1:] == doc_id[by_age][:-1])]
    age = np.empty(len(g), np.int64)
    age[by_age] = np.cumsum(~same)
    once = np.sort(by_age[~same])  # repeated rows count once
    several = once[np.bincount(group[once])[group[once]] > 1]
    out = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool), np.zeros(0, np.int64)]
    if not len(several):
        return tuple(out)
    m = len(several)
    group, around, age, place, low, high = (x[several] for x in (group, around, age, place, low, high))
    left, right = SuffixTree(group, around[:, :_REACH]), SuffixTree(group, around[:, _REACH:])
    state, copies = np.zeros((_REACH + 3, m), np.int8), np.zeros((_REACH + 3, m), np.int64)
    for o in range(_REACH + 1):
        act = np.flatnonzero((low <= o) & (o <= high))
        node = right.nodes(_REACH - o)[act] * (m + 2) + left.nodes(o)[act]
        order = np.argsort(node, kind="stable")
        ordered = node[order]
        head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(act) else np.zeros(0, np.int64)
        if not len(head):
            continue
        size = np.diff(np.append(head, len(act)))
        oldest = np.minimum.reduceat(age[act][order], head)
        row = act[order]
        n = np.repeat(size, size)
        state[o + 1, row] = np.where(n < 2, 0, np.where(age[row] == np.repeat(oldest, size), 1, 2))
        copies[o + 1, row] = n
    flat = state.T
    begin = np.argwhere((flat[:, 1:] != flat[:, :-1]) & (flat[:, 1:] > 0)) + [0, 1]
    end = np.argwhere((flat[:, 1:] != flat[:, :-1]) & (flat[:, :-1] > 0))
    row, o_low, o_high = begin[:, 0], begin[:, 1] - 1, end[:, 1] - 1
    n = np.zeros(len(row), np.int64)
    for d in range(int((o_high - o_low).max()) + 1 if len(row) else 0):
        o = np.minimum(o_low + d, o_high)
        n = np.maximum(n, copies[o + 1, row])
    return several[row], place[row] - o_high, place[row] - o_low + MIN_WORDS, state[o_low + 1, row] == 1, n


def _trees(batches):
    """Repeats of suffixes that come sorted by prefix, in groups of whole prefixes."""

    def solve(rows: pa.Table):
        around = np.frombuffer(b"".join(rows["around"].to_pylist()), ">u4").reshape(rows.num_rows, -1)
        # a null doc_id counts as the youngest
        ids = rows["doc_id"].fill_null(2**63 - 1).to_numpy()
        g, key, place, low, high = (rows[c].to_numpy() for c in ("g", "key", "place", "low", "high"))
        row, start, end, kept, n = repeats(g, key, ids, place.astype(np.int64), low, high, around)
        if len(row):
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([rows["key"].take(at).combine_chunks(), rows["doc_id"].take(at).combine_chunks(), *(pa.array(x.astype(np.int32)) for x in (start, end)), pa.array(kept), pa.array(n)], ["key", "doc_id", "start_word", "end_word", "kept", "copies"])

    keep, held = [], 0
    for batch in batches:
        keep.append(batch)
        held += batch.num_rows
        if held >= PACK:
            rows = pa.Table.from_batches(keep)
            g = rows["g"].to_numpy()
            last = int(np.searchsorted(g, g[-1]))
            if last:
                yield from solve(rows.slice(0, last))
                rows = rows.slice(last)
            keep, held = rows.combine_chunks().to_batches(), len(rows)
    if held:
        yield from solve(pa.Table.from_batches(keep))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row (key, doc_id, start_word, end_word, kept, copies) for each maximal passage of a document that is made of repeated windows of MIN_WORDS words.

    Words are counted from 0, end_word is exclusive, and case and white space don't matter.  Passages that are the first to
    occur (by doc_id, a null one last, then by place) have kept = true, and those that occurred before kept = false; copies is
    the greatest number of occurrences of a window of the passage.  Rows of equal doc_id and text count as one document,
    known by `key`, and neither as a repeat that goes.  Null, empty and shorter texts have no passages; other columns are ignored.
    """
    light_batches(docs.sparkSession)
    prefixes, whole = _prefixes(docs)
    runs = _suffixes(docs, prefixes).repartition("g").sortWithinPartitions("g").mapInArrow(lean(_trees), _RUNS)
    if len(whole):
        runs = runs.unionByName(_crowded_windows(docs, prefixes))
    by_place = Window.partitionBy("key", "kept").orderBy("start_word", "end_word")
    before = F.max("end_word").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    joined = runs.withColumn("fresh", (F.coalesce(before, F.lit(-1)) < F.col("start_word")).cast("int"))
    joined = joined.withColumn("passage", F.sum("fresh").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("key", "kept", "passage").agg(F.first("doc_id").alias("doc_id"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.max("copies").alias("copies")).drop("passage")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the passages that occurred before; n_chars, if there is such a column, follows the text.

    The first occurrence of a passage stays where it is.  Documents of which no word is left go; rows with null, empty or short texts stay as they are.
    """
    light_batches(docs.sparkSession)
    names, key, spans = docs.columns, free(docs, "_cut_key"), free(docs, "_cuts")
    cuts = repeated_passages(docs).where("not kept").groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(spans))
    cuts, own = written(cuts, "cuts"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    some, rest = parted(docs, own, cuts.select(key))
    marked = some.join(cuts, own == F.col(key), "left").select(*names, spans)
    text, n_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            spans = batch.column(len(names))
            some = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            columns = list(batch.columns[: len(names)])
            if len(some):
                texts, keep = columns[text].to_pylist(), np.ones(batch.num_rows, bool)
                for i in some:
                    texts[i] = without(texts[i], [(s["start_word"], s["end_word"]) for s in spans[i].as_py()])
                    keep[i] = texts[i] != ""
                columns[text] = pa.array(texts, columns[text].type)
                if n_chars is not None:
                    import pyarrow.compute as pc

                    mask = pa.array(spans.is_valid().to_numpy(zero_copy_only=False))
                    columns[n_chars] = pc.if_else(mask, pc.utf8_length(columns[text]).cast(columns[n_chars].type), columns[n_chars])
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(columns, names)

    return rest.unionByName(marked.mapInArrow(lean(run), docs.schema))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without runs of words (first word, end word), each with the white space after it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(raw, np.array([0, len(raw)]))
    edge = np.append(starts, len(raw))
    keep, at, whole = [], 0, raw.tobytes()
    for first, end in spans:
        if edge[end] > at:
            keep.append(whole[at : max(at, edge[first])])
            at = edge[end]
    keep.append(whole[at:])
    out = b"".join(keep)
    return (out.rstrip() if at == len(raw) else out).decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "kept", "copies")


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, {WORDS_SQL.format("text")} AS ws FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
starts AS (SELECT r, doc_id, ws, unnest(range(len(ws) - {MIN_WORDS - 1})) AS p FROM docs WHERE len(ws) >= {MIN_WORDS}),
hashed AS (SELECT r, doc_id, p, md5(array_to_string(ws[p + 1 : p + {MIN_WORDS}], ' ')) AS h FROM starts),
shared AS (SELECT r, doc_id, p, count(*) OVER w AS copies, row_number() OVER (w ORDER BY r, p) = 1 AS kept FROM hashed WINDOW w AS (PARTITION BY h) QUALIFY copies > 1),
fresh AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY r, kept ORDER BY p) > {MIN_WORDS}, true)::INT AS fresh FROM shared),
passages AS (SELECT *, sum(fresh) OVER (PARTITION BY r, kept ORDER BY p) AS passage FROM fresh)
SELECT any_value(doc_id) AS doc_id, min(p)::INT AS start_word, (max(p) + {MIN_WORDS})::INT AS end_word, (max(p) + {MIN_WORDS} - min(p))::INT AS n_words, kept, max(copies) AS copies
FROM passages GROUP BY r, kept, passage
"""
