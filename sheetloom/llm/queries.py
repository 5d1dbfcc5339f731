"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import bpe, decontam, fingerprint, jaccard, langid, ngram_lm, sharding, substring_dedup, token_store, url_filter
from sheetloom.llm.oracles import SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is good if the label of its id says quality and not toxic."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    outcomes = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.cast("int").alias("good"))
    return url_filter.judge(_read(spark, sf_dir, "pages"), outcomes)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_read(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digest(_read(spark, sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_byte_bpe, op3_substring_dedup, op4_ngram_lm, op5_sharding, op6_language_id, op7_ngram_jaccard, op8_token_store, op9_fingerprint, op10_decontamination)
}

__all__ = ["QUERIES", "SQL"]
