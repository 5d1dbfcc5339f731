"""A training-corpus pipeline: five stages over ``documents``, each written before the next reads it.

Every stage judges rows, not ids, so null and repeated ids are defined; an empty table stays empty; further columns are
carried by all stages but the last; very long texts are whole in each. What ``run`` writes goes when the driver ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import bpe, decontam, jaccard, langid, substring_dedup
from sheetloom.llm.shared import gone_at_exit, shared_folder, short_shuffles



def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined or doubtful go, null and empty texts among them."""
    return langid.identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id, a null id last, of rows of one id the first."""
    return jaccard.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts, and documents of which nothing stays; other texts are unchanged, null and empty ones too."""
    cut = substring_dedup.substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_words") > F.col("n_removed")))
    return left.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go, each judged by its own text, whatever its id."""
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, null or empty text having none, and whether they decode to the text."""
    coded = bpe.round_trip(docs)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL expresses neither the language model nor the tokenizer; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        with short_shuffles(spark):
            result.write.parquet(f"{folder}/{name}")
        gone_at_exit(spark, f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
