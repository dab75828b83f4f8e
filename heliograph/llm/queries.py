"""Queries and SQL of the training-data operators, by the name that they are registered under."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import bpe, decontamination, html_extraction, language_id, lm_scoring, media_columns, near_dedup, sharding, substring_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_sharding": sharding.query,
    "op3_decontamination": decontamination.query,
    "op4_language_id": language_id.query,
    "op5_token_counts": token_counts.query,
    "op6_media_columns": media_columns.query,
    "op7_lm_scoring": lm_scoring.query,
    "op8_near_dedup": near_dedup.query,
    "op9_bpe": bpe.query,
    "op10_html_extraction": html_extraction.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op2_sharding": sharding.ORACLE_SQL,
    "op3_decontamination": decontamination.ORACLE_SQL,
    "op5_token_counts": token_counts.ORACLE_SQL,
    "op9_bpe": bpe.ORACLE_SQL,
}
