"""Operator 5: token counts from an exact length histogram.

Each document is encoded once with a public byte-level BPE and reduced to its length; Spark aggregates documents by
length, so what is shuffled is one row per distinct length and task.  Suffix sums over the histogram - windows over
rows that number as many as there are distinct lengths, never documents - answer, for every context limit at once, how many documents
and tokens fit, how many tokens are left when longer documents are truncated or split, and all quantiles.

"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.bpe import PATTERN, RANKS, TOKENS_SQL
from heliograph.llm.common import lean, light_batches, table

#: Texts that are encoded in one call.
AT_ONCE = 256
_encoders: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(path: str, ranks: dict[bytes, int] | None = None):
    """The tiktoken encoding of a rank file or of what it holds, made once a process."""
    if path not in _encoders:
        import tiktoken

        _encoders[path] = tiktoken.Encoding("heliograph", pat_str=PATTERN, mergeable_ranks=ranks or load_ranks(path), special_tokens={})
    return _encoders[path]


def encoded_lengths(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens) of each row of docs; null and empty texts have no tokens. Repeated rows count each; other columns are ignored.

    The rank file, named by path, is read on the driver and broadcast (a vocabulary, whatever the data).
    """
    light_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches):
        encode = encoder(path, sent.value).encode_ordinary_batch
        for batch in batches:
            n = [len(x) for lo in range(0, batch.num_rows, AT_ONCE) for x in encode([t or "" for t in batch.column(1).slice(lo, AT_ONCE).to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row for each distinct length of (…, n_tokens): n_tokens, n_docs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """What each context limit L = n_tokens, of all lengths that occur, does to the corpus.

    docs_within / tokens_within: documents of at most L tokens, and their tokens;
    docs_over / tokens_over: longer documents, and all their tokens (suffix sums);
    truncated_tokens: tokens left when documents are cut at L; quantile: share of documents of at most L tokens.
    Between lengths that occur nothing changes but truncated_tokens, which grows by docs_over a token (see at_limit).
    An empty histogram gives no rows; documents of equal length (ties) share one.
    """
    after = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, t = F.col("n_docs"), F.col("n_docs") * F.col("n_tokens")
    over, over_t = F.coalesce(F.sum(n).over(after), F.lit(0)), F.coalesce(F.sum(t).over(after), F.lit(0))
    out = hist.select("n_tokens", "n_docs", over.alias("docs_over"), over_t.alias("tokens_over"), F.sum(n).over(whole).alias("_n"), F.sum(t).over(whole).alias("_t"))
    return out.select(
        "n_tokens",
        "n_docs",
        (F.col("_n") - F.col("docs_over")).alias("docs_within"),
        (F.col("_t") - F.col("tokens_over")).alias("tokens_within"),
        "docs_over",
        "tokens_over",
        (F.col("_t") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
        F.round((F.col("_n") - F.col("docs_over")) / F.col("_n"), 6).alias("quantile"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row for one context limit, whether or not any document has that length: n_docs, total_tokens, docs_within, truncated_tokens, chunks (documents split every `limit` tokens)."""
    n, t = F.col("n_docs"), F.col("n_tokens")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return hist.agg(
        zero(n).alias("n_docs"),
        zero(n * t).alias("total_tokens"),
        zero(F.when(t <= limit, n)).alias("docs_within"),
        zero(n * F.least(t, F.lit(limit))).alias("truncated_tokens"),
        zero(n * F.ceil(t / F.lit(limit))).alias("chunks"),
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the least length that a share q of documents doesn't exceed; no row for an empty histogram."""
    return limits(hist).where((F.col("docs_within") >= F.lit(q) * (F.col("docs_within") + F.col("docs_over")))).agg(F.min("n_tokens").alias("n_tokens")).where("n_tokens is not null")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(histogram(encoded_lengths(table(spark, sf_dir, "documents"))))


ORACLE_SQL = (
    TOKENS_SQL
    + """,
hist AS (SELECT n_tokens, count(*) AS n_docs FROM (SELECT coalesce(len(tokens), 0) AS n_tokens FROM encoded) GROUP BY n_tokens),
sums AS (SELECT n_tokens, n_docs, sum(n_docs) OVER () AS n, sum(n_docs * n_tokens) OVER () AS t,
  coalesce(sum(n_docs) OVER o, 0) AS docs_over, coalesce(sum(n_docs * n_tokens) OVER o, 0) AS tokens_over FROM hist WINDOW o AS (ORDER BY n_tokens DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT n_tokens, n_docs, (n - docs_over)::BIGINT AS docs_within, (t - tokens_over)::BIGINT AS tokens_within, docs_over::BIGINT AS docs_over, tokens_over::BIGINT AS tokens_over,
  (t - tokens_over + docs_over * n_tokens)::BIGINT AS truncated_tokens, round((n - docs_over)::DOUBLE / n, 6) AS quantile FROM sums
"""
)
