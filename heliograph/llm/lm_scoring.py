"""Operator 7: language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Words of the whole corpus are counted by Spark; the most frequent ones get a class of their own and all others share hashed
classes, so the neural part's size is fixed.  A context of two words predicts the class of the next
one: q = Q[w1] C1 + Q[w2] C2, score(w) = q . R[w] + b[w]; a word's share of its class comes from the table of all
word counts, which grows with the corpus and is joined, never gathered: p(word) = p(class | context) n(word) / (n(class) + 1).
What is left of a shared class, 1 / (n(class) + 1), is the probability of its words that the corpus doesn't have.

Texts are hashed twice, for the counts and for the classes of their words, which are kept in the shared folder as arrays; training and scoring read
those.  Training covers every document in ROUNDS rounds: each task
runs minibatch AdaGrad in numpy over all of its texts, telling words from NOISE words drawn from the counted unigram
distribution, and tasks' weights are averaged by number of words, in two levels of aggregation.  Noise is drawn by number of partition, so weights follow
the partitioning of the input, and equal runs over equal partitions give equal scores.

Scoring is normalised exactly.  A score is a sum of a term of w1 and a term of w2, so the normaliser of all contexts is one
matrix product, exp(Q C1 R') exp(Q C2 R' + b)', computed once and broadcast (CLASSES squared entries, whatever
the corpus); log-probabilities of classes are then gathered from three tables.  The distinct words of a chunk that share classes
are asked for in the word counts, in groups by hash, and their shares return to the chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import lean, light_batches, table, written
from heliograph.llm.textnum import chunks, hashed_words

#: Classes of the model: 0 is the edge of a text, then frequent words, then the shared ones.
CLASSES, SHARED = 2048, 256
DIM = 32
NOISE = 32
BATCH = 4096
ROUNDS = 2
RATE = 0.05
#: Rows of weights that are averaged together.
BLOCK = 64
#: Tokens of the corpus for each group that words and word counts meet in; bounds a worker's memory.
GROUP_TOKENS = 1 << 22
#: Bytes of text of a chunk: its words of shared classes are asked for once. Tokens of documents that travel in one row, one document at least.
CHUNK, ROW_TOKENS = 4 << 20, 1 << 17
#: Distinct words that a task counts before it passes them on; a matter of memory alone.
HELD = 1 << 20


@dataclass
class Vocabulary:
    """Sorted hashes of the words that have a class of their own, their classes, and the share of each class in the corpus.

    shared has the tokens of each shared class, counts the stored (word, n) of every word of the corpus; the latter stays with the driver.
    """

    hashes: np.ndarray
    classes: np.ndarray
    share: np.ndarray
    shared: np.ndarray
    counts: DataFrame | None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = (hashes % np.uint64(SHARED)).astype(np.int64) + CLASSES - SHARED
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            own = self.hashes[at] == hashes
            out[own] = self.classes[at[own]]
        return out


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class _Counter:
    """Words and how often they occur, merged in a task until there are HELD of them."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, words: np.ndarray) -> pa.RecordBatch | None:
        self.parts.append(np.unique(words, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > HELD:
            self.merge()
            if self.held > HELD // 2:
                return self.batch()
        return None

    def merge(self) -> None:
        words, at = np.unique(np.concatenate([w for w, _ in self.parts]), return_inverse=True)
        self.parts, self.held = [(words, np.bincount(at, np.concatenate([n for _, n in self.parts])).astype(np.int64))], len(words)

    def batch(self) -> pa.RecordBatch:
        (words, n), = self.parts
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, by its hash, occurs in all documents."""

    def run(batches):
        counter = _Counter()
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                if (full := counter.add(hashed_words(data, offs)[0])) is not None:
                    yield full
        if counter.parts:
            counter.merge()
            yield counter.batch()

    return _slim(docs).select("text").mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The vocabulary of a corpus; of equally frequent words the least hash goes first."""
    light_batches(docs.sparkSession)
    counts = written(word_counts(docs), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(CLASSES - SHARED - 1).toArrow()
    hashes, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(float)
    share = np.zeros(CLASSES)
    share[1 : 1 + len(n)] = n
    order = np.argsort(hashes)
    # the words that share classes, counted by class: SHARED rows, whatever the corpus
    unsigned = F.pmod(F.pmod("word", F.lit(SHARED)) + F.lit(SHARED), F.lit(SHARED))
    total = counts.groupBy(unsigned.alias("c")).agg(F.sum("n").alias("n")).toArrow()
    share[CLASSES - SHARED + total["c"].to_numpy()] = total["n"].to_numpy()
    np.subtract.at(share, CLASSES - SHARED + (hashes % np.uint64(SHARED)).astype(np.int64), n)
    shared = share[CLASSES - SHARED :].copy()
    share += 1.0
    share[0] = 0.0
    share /= share.sum()
    return Vocabulary(hashes[order], order + 1, share, shared, counts)


@dataclass
class Model:
    Q: np.ndarray
    R: np.ndarray
    b: np.ndarray
    C: np.ndarray

    @staticmethod
    def start(share: np.ndarray, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        f = lambda *n: rng.normal(0, 0.1, n).astype(np.float32)
        b = np.log(np.maximum(share, 1e-12)).astype(np.float32)
        return Model(f(CLASSES, DIM), f(CLASSES, DIM), b, np.stack([np.eye(DIM, dtype=np.float32) * x for x in (1.0, 0.5)]))

    def flat(self) -> np.ndarray:
        """All weights, as CLASSES rows."""
        c = np.zeros((CLASSES, 1), np.float32)
        c[: 2 * DIM * DIM, 0] = self.C.ravel()[:CLASSES]
        return np.concatenate([self.Q, self.R, self.b[:, None], c], 1)

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        return Model(*(np.ascontiguousarray(x) for x in (flat[:, :DIM], flat[:, DIM : 2 * DIM], flat[:, 2 * DIM])), flat[: 2 * DIM * DIM, 2 * DIM + 1].reshape(2, DIM, DIM).copy())


assert SHARED & (SHARED - 1) == 0, "words are grouped by the bits of their hash that don't tell the class"
assert 2 * DIM * DIM <= CLASSES, "the context matrices must fit a column of the weights"


def contexts(vocab: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class of each word, of the word before, of the one before that, first word of each document) of a chunk."""
    hashes, _, _, first = hashed_words(data, offs)
    return *_in_context(vocab.of(hashes), first), first


def _in_context(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w1, w2 = np.zeros_like(w), np.zeros_like(w)
    w1[1:], w2[2:] = w[:-1], w[:-2]
    at = first[:-1][first[:-1] < len(w)]
    w1[at] = 0
    w2[at] = 0
    w2[at[at + 1 < len(w)] + 1] = 0
    return w, w1, w2


class _Runs:
    """The distinct values of small integers and, for each of them, the sum of rows."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values.astype(np.int16), kind="stable")
        key = values[self.order]
        new = np.r_[True, key[1:] != key[:-1]]
        self.head = np.flatnonzero(new)
        self.values = key[self.head]
        #: Which of the distinct values each one is.
        self.which = np.empty(len(values), np.int64)
        self.which[self.order] = np.cumsum(new) - 1

    def sums(self, rows: np.ndarray) -> np.ndarray:
        pairs = rows[self.order].view(np.complex64)  # two sums in one
        return np.add.reduceat(pairs, self.head, axis=0).view(np.float32)


class Trainer:
    """AdaGrad on the noise-contrastive objective, from given weights."""

    def __init__(self, model: Model, share: np.ndarray, seed: int, rate: float = RATE):
        self.m = Model(model.Q.copy(), model.R.copy(), model.b.copy(), model.C.copy())
        self.rng, self.rate = np.random.default_rng(seed), np.float32(rate)
        self.cumulative = np.cumsum(share)
        self.log_noise = np.log(np.maximum(share, 1e-12) * NOISE).astype(np.float32)
        self.past = [np.full_like(x, 1e-2) for x in (self.m.Q, self.m.R, self.m.b, self.m.C)]
        self.grad = [np.zeros_like(self.m.Q), np.zeros_like(self.m.R), np.zeros_like(self.m.b)]
        self.seen = 0

    def gradients(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(changed rows of Q, changed rows of R and b, gradient of C) of the log-likelihood that words are told from noise; the rest is left in self.grad."""
        m, (gq, gr, gb) = self.m, self.grad
        near, far, own = _Runs(w1), _Runs(w2), _Runs(w)
        q1, q2, rt, rn = m.Q[near.values], m.Q[far.values], m.R[w], m.R[noise]
        p = (q1 @ m.C[0])[near.which]
        p += (q2 @ m.C[1])[far.which]
        true = np.einsum("ij,ij->i", p, rt) + (m.b - self.log_noise)[w]
        false = p @ rn.T
        false += (m.b - self.log_noise)[noise]
        gt = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        np.clip(false, -30, 30, out=false)
        np.negative(false, out=false)
        np.exp(false, out=false)
        false += 1
        gn = np.divide(-1, false, out=false)
        rt *= gt[:, None]
        rt += gn @ rn  # of p
        s1, s2 = near.sums(rt), far.sums(rt)
        gq[near.values] += s1 @ m.C[0].T
        gq[far.values] += s2 @ m.C[1].T
        from_noise = gn.T @ p
        p *= gt[:, None]
        gr[own.values] += own.sums(p)
        np.add.at(gr, noise, from_noise)
        gb += np.bincount(w, gt, CLASSES).astype(np.float32)
        np.add.at(gb, noise, gn.sum(0))
        return np.union1d(near.values, far.values), np.union1d(own.values, noise), np.stack([q1.T @ s1, q2.T @ s2])

    def _step(self, i: int, x: np.ndarray, rows: np.ndarray) -> None:
        g = self.grad[i][rows]
        self.grad[i][rows] = 0
        past = self.past[i]
        past[rows] += g * g
        x[rows] += self.rate * g / np.sqrt(past[rows])

    def batch(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> None:
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), CLASSES - 1)
        rows_q, rows_r, g = self.gradients(w, w1, w2, noise)
        self._step(0, self.m.Q, rows_q)
        self._step(1, self.m.R, rows_r)
        self._step(2, self.m.b, rows_r)
        self.past[3] += g * g
        self.m.C += self.rate * g / np.sqrt(self.past[3])
        self.seen += len(w)


_ENCODED = "chunk long, part int, words binary, doc_id array<long>, n_tokens array<long>, w binary, place binary"


def _planes(places: np.ndarray) -> np.ndarray:
    """Four arrays of bytes, lowest first: those of the high bytes compress to little."""
    return np.ascontiguousarray(places.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def _places(planes: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _groups(vocab: Vocabulary) -> int:
    return 1 + int(vocab.counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // GROUP_TOKENS


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The stored texts as classes, for train() and score(): rows of some documents of a chunk each (part null) with their ids, lengths, classes
    and places of their words of shared classes, and rows (chunk, part, words) of the chunk's latter, once each, by the group of words that they are in."""
    light_batches(docs.sparkSession)
    sent, groups = docs.sparkSession.sparkContext.broadcast(vocab), _groups(vocab)

    def run(batches):
        from pyspark import TaskContext

        vocab = sent.value
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1), CHUNK):
                hashes, _, _, first = hashed_words(data, offs)
                w = vocab.of(hashes)
                asked, at = np.unique(hashes[w >= CLASSES - SHARED], return_inverse=True)
                group = (asked // np.uint64(SHARED) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                held, begin = np.unique(group[order], return_index=True)
                asked = np.split(asked[order], begin[1:]) if len(held) else []
                names = ["chunk", "part", "words", "doc_id", "n_tokens", "w", "place"]
                n, w, place = np.diff(first), w.astype(np.int16), place[at]
                before = np.concatenate([[0], np.cumsum(w >= CLASSES - SHARED)])
                ids, row = batch.column(0).slice(lo, hi - lo), 0
                while row < hi - lo:
                    end = max(row + 1, int(np.searchsorted(first, first[row] + ROW_TOKENS, side="right")) - 1)
                    x, y = first[row], first[end]
                    cells = [_one(ids.slice(row, end - row)), _one(pa.array(n[row:end])), *(pa.array([z.tobytes()], pa.binary()) for z in (w[x:y], _planes(place[before[x] : before[y]])))]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *cells], names)
                    row = end
                none = [pa.nulls(len(held), k) for k in (pa.list_(ids.type), pa.list_(pa.int64()), pa.binary(), pa.binary())]
                if len(held):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), chunk)), pa.array(held.astype(np.int32)), pa.array([x.tobytes() for x in asked], pa.binary()), *none], names)
                chunk += 1

    return written(_slim(docs).mapInArrow(lean(run), _ENCODED), "classes")


def train(encoded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model after `rounds` passes over all documents, as encode() gives them. A corpus without words gives the model it starts with."""
    spark = encoded.sparkSession
    model, slim = Model.start(vocab.share), encoded.where("part is null").select("n_tokens", "w")
    width, share = model.flat().shape[1], vocab.share

    def average(batch: pa.Table) -> pa.Table:
        seen = batch["seen"].to_numpy().astype(float)
        rows = np.stack([np.frombuffer(x, np.float32) for x in batch["weights"].to_pylist()])
        mean = (rows * (seen / seen.sum())[:, None]).sum(0).astype(np.float32)
        return pa.table({"block": batch["block"][:1], "part": batch["part"][:1], "seen": pa.array([int(seen.sum())], pa.int64()), "weights": pa.array([mean.tobytes()], pa.binary())})

    schema = "block int, part int, seen long, weights binary"
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent, turn=turn):
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            trainer = Trainer(sent.value, share, seed=turn * 1_000_003 + part)
            for batch in batches:
                for n, w in zip(batch.column(0), batch.column(1), strict=True):
                    w, w1, w2 = _in_context(*_classes(n.values, w))
                    for i in range(0, len(w), BATCH):
                        trainer.batch(w[i : i + BATCH], w1[i : i + BATCH], w2[i : i + BATCH])
            if trainer.seen:
                flat = trainer.m.flat()
                n = CLASSES // BLOCK
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, part % 64, np.int32)), pa.array(np.full(n, trainer.seen)), pa.array([flat[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(n)], pa.binary())],
                    ["block", "part", "seen", "weights"],
                )

        means = slim.mapInArrow(lean(run), schema).groupBy("block", "part").applyInArrow(average, schema).groupBy("block").applyInArrow(average, schema)
        got = sorted(means.select("block", "weights").collect())
        if got:
            model = Model.of(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in got]).reshape(CLASSES, width))
    return model


def _classes(n_tokens: pa.Array, w: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(classes, first word of each document) of a chunk's row."""
    return np.frombuffer(w.as_buffer(), np.int16).astype(np.int64), np.concatenate([[0], np.cumsum(n_tokens.to_numpy())])


class Scorer:
    """The tables that normalised log-probabilities are read from."""

    def __init__(self, model: Model):
        self.near = model.Q @ model.C[0] @ model.R.T
        self.far = model.Q @ model.C[1] @ model.R.T + model.b
        self.far[:, 0] = -np.inf  # the edge of a text is never predicted
        a, b = self.near[:, 1:].max(1, keepdims=True), self.far[:, 1:].max(1, keepdims=True)
        self.log_z = np.log(np.exp(self.near - a) @ np.exp(self.far - b).T) + a + b.T

    def log_probs(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return self.near[w1, w] + self.far[w2, w] - self.log_z[w1, w2]


def score(encoded: DataFrame, vocab: Vocabulary, model: Model, tokens: bool = False) -> DataFrame:
    """One row (doc_id, n_tokens, log_prob, mean_log_prob) for each row of the docs that encode() was given, with token_log_probs (array of float) if tokens.

    log_prob is the sum of the words' log-probabilities given the two words before them, each normalised over all words of the corpus
    and, for each shared class, one word that stands for those it doesn't have.
    A null or empty text, or one of white space, has no tokens, a log_prob of 0 and a null mean. Repeated rows give repeated rows;
    other columns are ignored.
    """
    b = encoded.sparkSession.sparkContext.broadcast(Scorer(model))
    groups, shared = _groups(vocab), vocab.shared

    def shares(counts: pa.Table, asked: pa.Table) -> pa.Table:
        """The log of each asked word's share of its class, 4 bytes a word."""
        known, n = counts["word"].to_numpy().view(np.uint64), counts["n"].to_numpy()
        order = np.argsort(known)
        known, n = np.append(known[order], np.uint64(0)), np.append(n[order], 0)
        out = []
        for words in asked["words"].to_pylist():
            h = np.frombuffer(words, np.uint64)
            at = np.searchsorted(known[:-1], h)
            found = np.where(known[at] == h, n[at], 0)
            out.append((np.log(np.maximum(found, 1)) - np.log(shared[(h % np.uint64(SHARED)).astype(np.int64)] + 1)).astype(np.float32).tobytes())
        return pa.table({"chunk": asked["chunk"], "part": asked["part"], "shares": pa.array(out, pa.binary())})

    def of_classes(batches):
        """The chunks with the log-probabilities of classes of each cell (a document, or a token if tokens), and how many words of shared classes each has."""
        for batch in batches:
            chunk, ids, n_tokens, classes, place = batch.columns
            for i in range(batch.num_rows):
                w, first = _classes(n_tokens[i].values, classes[i])
                each = b.value.log_probs(*_in_context(w, first)).astype(np.float64)
                cells = np.arange(len(w) + 1) if tokens else first
                total, before = np.concatenate([[0.0], np.cumsum(each)]), np.concatenate([[0], np.cumsum(w >= CLASSES - SHARED)])
                base = each if tokens else total[first[1:]] - total[first[:-1]]
                lists = [_one(pa.array(base)), _one(pa.array(np.diff(before[cells]).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*(x.slice(i, 1) for x in (chunk, ids, n_tokens, place)), *lists], ["chunk", "doc_id", "n_tokens", "place", "base", "shared"])

    def joined(cells: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("part")
        share = np.frombuffer(b"".join(found["shares"].to_pylist()), np.float32).astype(np.float64)
        out = []
        for ids, n, base, count, place in zip(*(cells[c] for c in ("doc_id", "n_tokens", "base", "shared", "place")), strict=True):
            n, base, count = (x.values.to_numpy() for x in (n, base, count))
            each = base + np.bincount(np.repeat(np.arange(len(base)), count), share[_places(place)], len(base))
            first = np.concatenate([[0], np.cumsum(n)])
            total = np.concatenate([[0.0], np.cumsum(each)])
            sums = total[first[1:]] - total[first[:-1]] if tokens else each
            mean = np.where(n > 0, sums / np.maximum(n, 1), np.nan)
            columns = [ids.values, pa.array(n), pa.array(sums.round(6)), pa.array(mean.round(6), mask=n == 0)]
            if tokens:
                columns.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(each.astype(np.float32))))
            out.append(pa.table(columns, ["doc_id", "n_tokens", "log_prob", "mean_log_prob", "token_log_probs"][: len(columns)]))
        return pa.concat_tables(out)

    # the same group as in encode(): of the unsigned hash, without its bits that tell the class
    part = F.pmod(F.shiftrightunsigned("word", SHARED.bit_length() - 1), F.lit(groups).cast("long")).cast("int")
    counts = vocab.counts.select(part.alias("part"), "word", "n")
    asked = encoded.where("part is not null").select("part", "chunk", "words")
    found = counts.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(shares, "chunk long, part int, shares binary")
    cells = encoded.where("part is null").select("chunk", "doc_id", "n_tokens", "w", "place")
    cells = cells.mapInArrow(lean(of_classes), "chunk long, doc_id array<long>, n_tokens array<long>, place binary, base array<double>, shared array<int>")
    return cells.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(joined, "doc_id long, n_tokens long, log_prob double, mean_log_prob double" + ", token_log_probs array<float>" * tokens)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocab = vocabulary(docs)
    encoded = encode(docs, vocab)
    return score(encoded, vocab, train(encoded, vocab))
