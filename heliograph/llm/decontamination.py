"""Operator 3: benchmark decontamination with training suffix arrays.

The training texts of a task are cut into shards of a few megabytes.  Each shard gets a word-level
generalised suffix array by prefix doubling: words become dense ranks, every document ends in a
sentinel of its own, and only suffixes that still tie are sorted again at twice the depth.  Every
suffix of every benchmark item is then looked up in the shard by binary search, one word deeper at
a time for all suffixes at once; the intervals that survive `min_words` words hold all training
positions that share so many words, and comparing on from there gives each match's full length.
Documents never cross shards, so nothing is shuffled: benchmark suffixes travel, not the corpus.

The benchmark is broadcast in slices of at most SLICE_BYTES of text, one pass over the documents
each, so that a benchmark of any size fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import lean, light_batches, table
from heliograph.llm.textnum import chunks, hashed_words

#: Words that a verbatim match must have; items of fewer words must be there whole.
MIN_WORDS = 8
#: Benchmark items of fewer words than this could be in any text: they match documents that consist of them.
LEAST_ITEM_WORDS = 5
SLICE_BYTES = 32 << 20
#: Bytes of training text of a suffix array.
SHARD_BYTES = 4 << 20

MATCHES = "doc_id long, item_id long, match_words int, doc_word int, item_word int"


class SuffixArray:
    """Sorted word suffixes of a shard of documents (word hashes and each document's first word)."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        n_docs, lengths = len(first) - 1, np.diff(first)
        self.vocabulary, ranks = np.unique(hashes, return_inverse=True)
        n = len(hashes) + n_docs
        ends = first[1:] + np.arange(n_docs)
        self.rank = np.empty(n, np.int64)
        is_word = np.ones(n, bool)
        is_word[ends] = False
        self.rank[ends] = np.arange(n_docs)
        self.rank[is_word] = ranks + n_docs
        self.n_docs, self.start = n_docs, first[:-1] + np.arange(n_docs)
        self.document = np.repeat(np.arange(n_docs), lengths + 1)
        self.order = self._sort()
        #: Where suffixes that begin with each rank start.
        self.begin = np.searchsorted(self.rank[self.order], np.arange(n_docs + len(self.vocabulary) + 1))

    def _sort(self) -> np.ndarray:
        n, bits = len(self.rank), max(1, int(self.n_docs + len(self.vocabulary)).bit_length())
        if not n:
            return np.zeros(0, np.int64)
        depth = max(1, 63 // bits)
        padded = np.concatenate([self.rank, np.zeros(depth, np.int64)])
        key = padded[:n].copy()
        for j in range(1, depth):
            key <<= bits
            key |= padded[j : j + n]
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        place = np.empty(n + 1, np.int64)  # a suffix's class: where its run of ties begins
        heads = np.flatnonzero(new)
        place[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        place[n] = -1
        while True:
            sizes = np.diff(np.append(heads, n))
            tied = sizes > 1
            if not tied.any():
                return order
            at = np.flatnonzero(np.repeat(tied, sizes))
            suffix = order[at]
            own = place[suffix]
            then = place[np.minimum(suffix + depth, n)]
            sub = np.lexsort((then, own)) if n >= 1 << 31 else np.argsort(own << 32 | (then + 1), kind="stable")
            order[at] = suffix = suffix[sub]
            own, then = own[sub], then[sub]
            fresh = np.empty(len(at), bool)
            fresh[0] = True
            fresh[1:] = (own[1:] != own[:-1]) | (then[1:] != then[:-1])
            new[at] = fresh
            heads = np.flatnonzero(new)
            place[order] = np.repeat(heads, np.diff(np.append(heads, n)))
            depth *= 2

    def ranks_of(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of other words in this shard; -1 for words that it doesn't have."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + self.n_docs, -1)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        last = len(self.rank) - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self.rank[np.minimum(self.order[np.minimum(mid, last)] + depth, last)] < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def find(self, ranks: np.ndarray, at: np.ndarray, need: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into at, training position, words in common) of each place that shares need words, at least, with a test suffix.

        ranks: the test words; at: where each test suffix starts; need: words that it must share; stop: where its item ends.
        """
        word = ranks[at]
        live = np.flatnonzero(word >= 0)
        lo, hi = self.begin[word[live]], self.begin[word[live] + 1]
        depth, found = 1, []
        while len(live):
            done = need[live] <= depth
            for i, a, b in zip(live[done], lo[done], hi[done], strict=True):
                found.append((i, a, b, depth))
            live, lo, hi = live[~done], lo[~done], hi[~done]
            if not len(live):
                break
            want = ranks[at[live] + depth]
            a = self._bound(lo, hi, depth, want)
            b = self._bound(a, hi, depth, want + 1)
            keep = (want >= 0) & (a < b)
            live, lo, hi = live[keep], a[keep], b[keep]
            depth += 1
        if not found:
            return (np.zeros(0, np.int64),) * 3
        who = np.concatenate([np.full(b - a, i) for i, a, b, _ in found])
        where = np.concatenate([self.order[a:b] for _, a, b, _ in found])
        common = np.concatenate([np.full(b - a, d) for _, a, b, d in found])
        more = np.arange(len(who))
        while len(more):
            test, train = at[who[more]] + common[more], where[more] + common[more]
            inside = test < stop[who[more]]
            more, test, train = more[inside], test[inside], train[inside]
            more = more[self.rank[train] == ranks[test]]
            common[more] += 1
        return who, where, common


class Benchmark:
    """Word hashes of the benchmark items of a slice, and their suffixes."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int):
        kept, hs, least = [], [np.zeros(0, np.uint64)], []
        for i, text in zip(ids, texts, strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h = hashed_words(raw, np.array([0, len(raw)]))[0]
            if len(h):
                kept.append(i)
                hs.append(h)
                least.append(min(min_words, len(h)))
        self.sizes = sizes = np.array([len(h) for h in hs[1:]], np.int64)
        least = np.array(least, np.int64)
        self.ids, self.hashes = np.array(kept, np.int64), np.concatenate(hs)
        self.item_start = np.cumsum(sizes) - sizes
        each = sizes - least + 1  # suffixes that are long enough
        self.item = np.repeat(np.arange(len(kept)), each)
        self.at = np.arange(len(self.item)) - np.repeat(np.cumsum(each) - each, each) + self.item_start[self.item]
        self.need, self.stop = least[self.item], (self.item_start + sizes)[self.item]

    def matches(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, words, word in document, word in item): the longest match of each document and item of a shard."""
        hashes, _, _, first = hashed_words(data, offs)
        if not len(hashes) or not len(self.at):
            return (np.zeros(0, np.int64),) * 5
        sa = SuffixArray(hashes, first)
        who, where, common = sa.find(sa.ranks_of(self.hashes), self.at, self.need, self.stop)
        doc, item = sa.document[where], self.item[who]
        ok = (self.sizes[item] >= LEAST_ITEM_WORDS) | (self.sizes[item] == np.diff(first)[doc])
        who, where, common, doc, item = (x[ok] for x in (who, where, common, doc, item))
        doc_word, item_word = where - sa.start[doc], self.at[who] - self.item_start[item]
        best = np.lexsort((item_word, doc_word, -common, item, doc))
        doc, item, common, doc_word, item_word = (x[best] for x in (doc, item, common, doc_word, item_word))
        if len(doc):
            lead = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]
            doc, item, common, doc_word, item_word = (x[lead] for x in (doc, item, common, doc_word, item_word))
        return doc, item, common, doc_word, item_word


def _slices(bench: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Benchmark rows in slices that may be broadcast."""
    items = bench.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // SLICE_BYTES))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))


def find_matches(docs: DataFrame, bench: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row (doc_id, item_id, match_words, doc_word, item_word) for each document and benchmark item
    that share min_words consecutive words, or the whole of an item of fewer words (which is the whole document too, where the item has fewer than LEAST_ITEM_WORDS).

    match_words is the length of their longest common run (whatever its case and white space), doc_word and item_word
    where it starts, in words; of equally long runs the first in the document, then the first in the item.
    Null and empty texts and items match nothing; a null doc_id or
    item_id is reported as null (item_id -1 where null).  A document row that occurs twice is reported twice; benchmark
    rows that occur twice count once.  Other columns are ignored.
    """
    spark = docs.sparkSession
    light_batches(spark)
    out = None
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for rows in _slices(bench, "item_id", "text"):
        b = spark.sparkContext.broadcast(Benchmark([-1 if r["item_id"] is None else r["item_id"] for r in rows], [r["text"] for r in rows], min_words))

        def run(batches, b=b):
            for batch in batches:
                ids = batch.column(0)
                for lo, hi, data, offs in chunks(batch.column(1), SHARD_BYTES):
                    doc, item, common, dw, iw = b.value.matches(data, offs)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays(
                            [ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(b.value.ids[item]), *(pa.array(x.astype(np.int32)) for x in (common, dw, iw))],
                            ["doc_id", "item_id", "match_words", "doc_word", "item_word"],
                        )

        found = slim.mapInArrow(lean(run), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that share no run of min_words words (nor a shorter item whole) with the benchmark.

    Rows are kept or dropped whole, with all their columns; null and empty texts are kept.  One pass, no shuffle.
    """
    spark = docs.sparkSession
    light_batches(spark)
    where = docs.columns.index("text")
    for rows in _slices(bench, "item_id", "text"):
        b = spark.sparkContext.broadcast(Benchmark([-1 if r["item_id"] is None else r["item_id"] for r in rows], [r["text"] for r in rows], min_words))

        def run(batches, b=b):
            for batch in batches:
                for lo, hi, data, offs in chunks(batch.column(where), SHARD_BYTES):
                    keep = np.ones(hi - lo, bool)
                    keep[b.value.matches(data, offs)[0]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words as the operator takes them: runs of bytes above 0x20, ASCII letters in lower case.
WORDS_SQL = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x20]+')"
_GRAM = " || ' ' || ".join(f"lead(w, {j}) OVER o" for j in range(MIN_WORDS))
ORACLE_SQL = f"""
WITH d AS (SELECT r, doc_id, p, {_GRAM} AS g
  FROM (SELECT r, doc_id, generate_subscripts(ws, 1) - 1 AS p, unnest(ws) AS w FROM (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format("text")} AS ws FROM documents)) WINDOW o AS (PARTITION BY r ORDER BY p)),
b AS (SELECT i, item_id, p, {_GRAM} AS g
  FROM (SELECT i, item_id, generate_subscripts(ws, 1) - 1 AS p, unnest(ws) AS w FROM (SELECT row_number() OVER () AS i, item_id, {WORDS_SQL.format("text")} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark))) WINDOW o AS (PARTITION BY i ORDER BY p)),
m AS (SELECT r, doc_id, i, item_id, d.p AS dp, b.p AS ip, d.p - row_number() OVER (PARTITION BY r, i, d.p - b.p ORDER BY d.p) AS island FROM d JOIN b USING (g)),
runs AS (SELECT r, doc_id, i, item_id, count(*) + {MIN_WORDS - 1} AS n, min(dp) AS dw, min(ip) AS iw FROM m GROUP BY r, doc_id, i, item_id, dp - ip, island)
SELECT doc_id, coalesce(item_id, -1) AS item_id, n::INT AS match_words, dw::INT AS doc_word, iw::INT AS item_word FROM runs
QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY n DESC, dw, iw) = 1
"""
