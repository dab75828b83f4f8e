"""Corpus pipeline: stages over the documents table, each reading what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of documents; rows that a
stage drops and passages that it cuts are gone for those after it.  Null and empty texts have no language and end at the first stage; an
empty table passes through.  Texts of any length are worked on whole.  Of equal texts (ties) the row of the least doc_id stays, one without an
id last, and of repeated rows one does; texts that share a doc_id are documents of their own.  Further columns, whatever their names, stay as they are, but for tokens and
decoded, which the last stage replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import bpe, decontamination, language_id, near_dedup, substring_dedup
from heliograph.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no known language and texts that are not in the language that they are said to be in."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of the least doc_id."""
    return near_dedup.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that occurred before, and drops documents of which nothing is left."""
    return substring_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, tokens (byte-level BPE of text), and decoded, the text that they stand for."""
    return bpe.encode_decode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language-id", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("substring-dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("byte-level-bpe", encode),
]

#: SQL can't express these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each one returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
