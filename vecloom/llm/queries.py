"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fingerprints, html_text, language, media, mixing, simhash, substrings, suffix_dedup, token_counts
from .common import documents, materialize


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(documents(spark, sf_dir), size=200, keep_bytes=False)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir), seed=42)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_ids(documents(spark, sf_dir), width=4, most=4)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(materialize(media.store(documents(spark, sf_dir))))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(documents(spark, sf_dir).select("doc_id", "text"), size=13, keep_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_suffix_dedup, op3_mixing, op4_token_counts, op5_simhash, op6_fingerprints, op7_byte_bpe, op8_language, op9_media, op10_substrings)
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.SQL.format(docs="documents")}
