"""Results as JSON, CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPACT = ("document_id", "filename", "extracted_text", "structured_data", "confidence")


def result_name(filename: Column) -> Column:
    return F.concat(F.regexp_replace(filename, r"\.[^.]*$", ""), F.lit("_result.json"))


def structured_data(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, structured_data: category -> values in order, from rows of (id, category, pattern_idx, match_idx, value)."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("pattern_idx", "match_idx", "value"))), lambda m: m["value"])
    return found.groupBy(id_col, "category").agg(values.alias("values")).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("category", "values"))).alias("structured_data"))


def extracted_tables(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As structured_data, each value with a confidence and its source."""
    return structured_data(found, id_col).select(id_col, F.transform_values("structured_data", lambda _, vs: F.transform(vs, lambda v: F.struct(v.alias("value"), F.lit(0.8).alias("confidence"), F.lit("regex_pattern").alias("source")))).alias("extracted_data_tables"))


def compact(results: DataFrame) -> DataFrame:
    return results.select(*COMPACT)


def write(results: DataFrame, folder: str, kind: str = "json") -> None:
    """One row per document in ``json``, ``csv`` (nested values as JSON) or ``parquet``."""
    if kind == "csv":
        nested = [f.name for f in results.schema if f.dataType.typeName() in ("array", "map", "struct")]
        results.withColumns({c: F.to_json(c) for c in nested}).write.option("header", True).csv(folder)
    else:
        getattr(results.write, kind)(folder)


def batch_report(files: DataFrame, error: str = "error") -> DataFrame:
    return files.agg(F.count("*").alias("total_files"), F.count_if(F.col(error).isNull()).alias("successful"), F.count_if(F.col(error).isNotNull()).alias("failed"))
