"""Operator 4: language identification by multinomial naive Bayes over hashed character n-grams.

Training reads a bounded, hash-chosen sample of labelled rows (SAMPLE_PER_LANGUAGE of each language); n-gram
counts are summed by Spark, and the matrix of log-probabilities - buckets by languages, its size fixed by BUCKETS and
the number of languages - is broadcast.  Scoring covers every document and its whole text: code points of a chunk
become n-gram buckets in a few numpy passes, and a sparse product (bucket rows gathered, then summed by document)
gives the log-likelihood of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import lean, light_batches, table
from heliograph.llm.textnum import chunks, code_points

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bound of the labelled sample that the classifier is fitted on.
SAMPLE_PER_LANGUAGE = 1500
ALPHA = 0.5
#: A declared language is rejected where its posterior is under this.
LEAST_POSTERIOR = 0.01
#: Log-probability that a text's n-grams may fall behind the mean of their language before the text counts as no language; the second, over the root of their number, is added.
SLACK, SLACK_SHORT = 3.0, 10.0

#: Bytes of text whose n-grams are held at once; bounds a worker's memory, not the work done.
AT_ONCE = 1 << 20
#: Places of a text whose n-grams are summed at once.
BLOCK = 1 << 20

SCORES = "doc_id long, lang string, posterior double, log_prob_per_ngram double, n_ngrams long"


def ngram_blocks(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, document of each n-gram) of a chunk, by order and position, for BLOCK places at a time.

    Letters are folded to lower case (ASCII and Latin-1), runs of white space, digits and ASCII punctuation count as one
    space, and n-grams don't cross documents.  An n-gram of spaces alone is left out.
    """
    fold, at = code_points(data, offs)
    n = len(fold)
    if not n:
        return
    fold = fold.copy()
    upper = ((fold >= 65) & (fold <= 90)) | ((fold >= 0xC0) & (fold <= 0xDE) & (fold != 0xD7))
    fold[upper] += 32
    letter = (fold >= 97) & (fold <= 122) | (fold >= 0xAA) & (fold != 0xD7) & (fold != 0xF7)
    fold[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1][at[:-1] < n]] = True  # a text starts and words end with one space
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(at))[keep]
    fold, letter = fold[keep], letter[keep]
    for lo in range(0, len(fold), BLOCK):
        block = slice(lo, lo + BLOCK + max(ORDERS) - 1)
        yield _ngrams(fold[block], letter[block], doc[block])


def _ngrams(fold: np.ndarray, letter: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and documents of the n-grams that begin in the first BLOCK places."""
    buckets, docs = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    h = np.zeros(len(fold), np.uint32)
    some = np.zeros(len(fold), bool)
    for k in range(1, max(ORDERS) + 1):
        m = len(fold) - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + fold[k - 1 :] * np.uint32(0x9E3779B1)
        some = some[:m] | letter[k - 1 :]
        if k in ORDERS:
            inside = (some & (doc[:m] == doc[k - 1 :]))[:BLOCK]
            x = h[:BLOCK][inside] + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            buckets.append((x & np.uint32(BUCKETS - 1)).astype(np.int32))
            docs.append(doc[:m][:BLOCK][inside])
    return np.concatenate(buckets), np.concatenate(docs)


def ngram_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ngram_blocks() of a chunk as one."""
    none = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    return tuple(np.concatenate(x) for x in zip(*none, *ngram_blocks(data, offs), strict=True))


@dataclass
class Model:
    """Log-probabilities of buckets (rows) for languages (columns), log priors, and each language's usual log-probability per n-gram."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray
    usual: np.ndarray

    def log_likelihood(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents by languages, n-grams of each document)."""
        n_docs = len(offs) - 1
        total, count = np.zeros((n_docs, len(self.languages))), np.zeros(n_docs, np.int64)
        for buckets, docs in ngram_blocks(data, offs):
            if not len(docs):
                continue
            edge = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
            # (n-gram order, document) runs are contiguous; np.add.at joins the runs of a document
            sums = np.stack([np.add.reduceat(column[buckets], edge) for column in self.log_prob.T], 1)
            np.add.at(total, docs[edge], sums)
            np.add.at(count, docs[edge], np.diff(np.append(edge, len(docs))))
        return total, count

    def classify(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best language or -1, posteriors, log-probability per n-gram of the best, n-grams) of each document."""
        ll, n = self.log_likelihood(data, offs)
        score = ll + self.prior
        best = score.argmax(1)
        post = np.exp(score - score.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mean = np.where(n > 0, ll[np.arange(len(best)), best] / np.maximum(n, 1), 0.0)
        return np.where((n > 0) & (mean >= self.usual[best] - SLACK - SLACK_SHORT / np.sqrt(np.maximum(n, 1))), best, -1), post, mean, n


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of the languages that docs.lang names; rows without a text or a language aren't used, nor do they count in shares and priors.

    Rows, those without a doc_id too, are chosen by the hash of doc_id and text, about per_language of each language, so the choice is the same on every run.
    """
    light_batches(docs.sparkSession)
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id").where("lang is not null and text is not null and trim(text) != ''")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float64), np.zeros(0), np.zeros(0))
    languages = sorted(sizes)
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, per_language / sizes[x]))) for x in languages])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches):
        code = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            label = np.array([code[x] for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, data, offs in chunks(batch.column(1), AT_ONCE):
                for buckets, docs in ngram_blocks(data, offs):
                    key, n = np.unique(label[lo:hi][docs] * BUCKETS + buckets, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    counts = np.zeros(len(languages) * BUCKETS)
    summed = sample.select("lang", "text").mapInArrow(lean(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts[summed["key"].to_numpy()] = summed["n"].to_numpy()
    counts = counts.reshape(len(languages), BUCKETS)
    log_prob = np.log(counts + ALPHA) - np.log(counts.sum(1, keepdims=True) + ALPHA * BUCKETS)
    usual = (counts * log_prob).sum(1) / np.maximum(counts.sum(1), 1)
    total = sum(sizes.values())
    return Model(languages, np.ascontiguousarray(log_prob.T), np.log([sizes[x] / total for x in languages]), usual)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row (doc_id, lang, posterior, log_prob_per_ngram, n_ngrams) for each row of docs.

    lang is 'und' where a text has no letters (null and empty texts too) or is unlike any language of the model;
    of equally likely languages the first by name is taken.  Repeated rows give repeated rows; other columns are ignored.
    """
    light_batches(docs.sparkSession)
    b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = np.array([*b.value.languages, "und"], object)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1), AT_ONCE):
                if b.value.languages:
                    best, post, mean, n = b.value.classify(data, offs)
                    top = np.where(n > 0, post.max(1), 0.0)
                else:
                    best, top, mean, n = np.full(hi - lo, -1), np.zeros(hi - lo), np.zeros(hi - lo), np.zeros(hi - lo, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(top.round(6)), pa.array(mean.round(6)), pa.array(n)],
                    ["doc_id", "lang", "posterior", "log_prob_per_ngram", "n_ngrams"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SCORES)


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_POSTERIOR) -> DataFrame:
    """The rows of docs whose text is in a known language and whose declared language, if the model knows it, is not improbable.

    Rejected: texts without letters, texts unlike any language, and texts whose declared language has a posterior under
    `least`.  Rows without a declared language, or with one that the model doesn't know, are judged by their text alone.
    """
    light_batches(docs.sparkSession)
    b = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        code = {x: i for i, x in enumerate(b.value.languages)}
        for batch in batches:
            declared = np.array([code.get(x, -1) for x in batch.column(lang).to_pylist()], np.int64)
            for lo, hi, data, offs in chunks(batch.column(text), AT_ONCE):
                keep = np.zeros(hi - lo, bool)
                if code:
                    best, post, _, n = b.value.classify(data, offs)
                    said = declared[lo:hi]
                    keep = (best >= 0) & ((said < 0) | (post[np.arange(hi - lo), np.maximum(said, 0)] >= least))
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
