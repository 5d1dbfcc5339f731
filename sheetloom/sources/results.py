"""Results of documents: elements, tables and whole documents as rows and as JSON, reports of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a whole result, in order.
KEYS = ("document_id", "filename", "total_pages", "processing_method", "document_type", "extracted_text", "structured_data", "tables", "elements", "images", "spatial_analysis", "confidence", "processing_metrics", "metadata", "timestamp")
COMPACT = ("document_id", "filename", "extracted_text", "structured_data", "confidence")
PATTERN_CONFIDENCE = 0.8


def box() -> Column:
    """x, y, width, height and confidence; null without a box."""
    return F.when(F.col("x").isNotNull(), F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"), "confidence"))


def element_id(*keys: str) -> Column:
    """The same in every run: a digest of what identifies the row."""
    return F.substring(F.sha2(F.concat_ws("/", *keys), 256), 1, 32)


def sorted_by(rows: Column, *names: str) -> Column:
    """An array of structs in the order of some of their fields; the others, maps among them, need none."""
    key = lambda r: F.struct(*[r[n].alias(n) for n in names])
    return F.array_sort(rows, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def element_rows(elements: DataFrame) -> DataFrame:
    """doc_id and one struct for each element: text, element_type, page_number, confidence, bbox, metadata, element_id."""
    metadata = F.col("metadata") if "metadata" in elements.columns else F.map_from_arrays(F.array(F.lit("ocr_engine")), F.array("engine")) if "engine" in elements.columns else F.create_map().cast("map<string,string>")
    one = F.struct("text", "element_type", "page_number", "confidence", box().alias("bbox"), metadata.alias("metadata"), element_id("doc_id", "page_number", "ord").alias("element_id"))
    return elements.select("doc_id", "page_number", "ord", one.alias("element"))


def table_rows(tables: DataFrame) -> DataFrame:
    """doc_id and one struct for each table (table_id, rows, headers, page_number, confidence, x ... h, cells): its cells are counted."""
    has = tables.columns
    of = lambda name, other: F.col(name) if name in has else other
    counted = F.size("cells") if "cells" in has else F.aggregate("rows", F.lit(0), lambda n, r: n + F.size(r))
    one = F.struct("table_id", of("headers", F.get("rows", F.lit(0))).alias("headers"), "rows", of("page_number", F.lit(1)).alias("page_number"), of("confidence", F.lit(0.0)).alias("confidence"), of("structure_type", F.lit("standard")).alias("structure_type"), (box() if "x" in has else F.lit(None).cast("struct<x: double, y: double, width: double, height: double, confidence: double>")).alias("bbox"), counted.alias("cell_count"))
    return tables.select("doc_id", one.alias("table"))


def metrics(elements: DataFrame) -> DataFrame:
    """doc_id, processing_metrics."""
    from sheetloom.operators.elements import metrics as counted

    found = counted(elements)
    return found.select("doc_id", F.struct(*[c for c in found.columns if c != "doc_id"]).alias("processing_metrics"))


def full(docs: DataFrame, elements: DataFrame, tables: DataFrame, structured: DataFrame, confidence: DataFrame) -> DataFrame:
    """A row of the columns ``KEYS`` for every document.

    docs: doc_id, filename, total_pages, text and document_type. structured: doc_id, structured_data. confidence: doc_id,
    confidence. A document's elements and tables are gathered with it, as a result is one record. No part is broadcast: Spark
    takes what was derived from small compressed files for small.
    """
    in_order = F.transform(sorted_by(F.collect_list(F.struct("page_number", "ord", "element")), "page_number", "ord"), lambda e: e["element"])
    own = element_rows(elements).groupBy("doc_id").agg(in_order.alias("elements"), F.struct(F.count("*").alias("total_elements"), F.max("page_number").alias("pages")).alias("spatial_analysis"))
    grids = table_rows(tables).groupBy("doc_id").agg(sorted_by(F.collect_list("table"), "table_id").alias("tables"))
    whole = docs
    for part in (own, grids, structured, confidence, metrics(elements)):
        whole = whole.join(part.hint("merge"), "doc_id", "left")
    method = F.when(F.col("elements").isNull(), "pdf_text").otherwise("hybrid")
    none = F.array().cast("array<struct<image_id: string, page_number: int, format: string, size: bigint>>")
    return whole.select(
        F.col("doc_id").cast("string").alias("document_id"),
        "filename",
        "total_pages",
        method.alias("processing_method"),
        "document_type",
        F.col("text").alias("extracted_text"),
        "structured_data",
        "tables",
        "elements",
        none.alias("images"),
        "spatial_analysis",
        F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"),
        "processing_metrics",
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.current_timestamp().alias("timestamp"),
    )


def structured_format(results: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, document_metadata, extracted_data_tables, quality_metrics, from whole results and their pattern matches."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("pattern_idx", "match_idx", "value"))), lambda m: F.struct(m["value"].alias("value"), F.lit(PATTERN_CONFIDENCE).alias("confidence"), F.lit("regex_pattern").alias("source")))
    by = found.groupBy(F.col("doc_id").cast("string").alias("document_id"), "category").agg(values.alias("values"), F.count("*").alias("n"))
    data = by.groupBy("document_id").agg(F.map_from_entries(sorted_by(F.collect_list(F.struct("category", "values")), "category")).alias("extracted_data_tables"), F.sum("n").alias("patterns_matched"))
    whole = results.join(data.hint("merge"), "document_id", "left")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return whole.select(
        "document_id",
        F.struct("filename", "total_pages", "document_type", "confidence").alias("document_metadata"),
        "extracted_data_tables",
        F.struct(F.greatest(count("elements"), F.lit(0)).alias("ocr_elements"), F.greatest(count("tables"), F.lit(0)).alias("tables_found"), F.coalesce("patterns_matched", F.lit(0)).alias("patterns_matched")).alias("quality_metrics"),
    )


def write_each(results: DataFrame, folder: str) -> None:
    """One JSON file for each document, in a folder of its own named as its result: ``file=<stem>_result.json``."""
    from sheetloom.sources.sinks import result_name

    rows = results.select(result_name(F.col("filename")).alias("file"), F.to_json(F.struct(*results.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    rows.repartition("file").write.partitionBy("file").text(folder)


def batch(results: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, results, errors) of a batch: total_files, successful, failed; (file, document_id, confidence); (file, stage, error_class, message).

    The lists stay tables, whatever the size of the batch.
    """
    done = results.select(F.col("filename").alias("file"), "document_id", "confidence")
    counts = done.agg(F.count("*").alias("successful")).crossJoin(errors.agg(F.count_distinct("file").alias("failed")))  # one row each
    return counts.select((F.col("successful") + F.col("failed")).alias("total_files"), "successful", "failed"), done, errors


def n_categories() -> Column:
    """How many categories of a result have values."""
    filled = F.size(F.map_filter("structured_data", lambda _, v: F.size(v) > 0))
    return F.when(F.col("structured_data").isNull(), 0).otherwise(filled)


def kpis(results: DataFrame) -> DataFrame:
    """document_id, pages and the number of categories with values."""
    return results.select("document_id", F.col("total_pages").alias("pages"), n_categories().alias("categories"))


def ground_truth(spark, path: str, kind: str = "json") -> DataFrame:  # noqa: ANN001
    """Ground truth as it is kept: reference texts, fields and boxes by document."""
    shape = "document_id string, source_file string, reference_text string, structured_fields map<string,array<string>>, bounding_boxes array<struct<x: double, y: double, w: double, h: double>>, metadata map<string,string>, creation_date timestamp, annotator string"
    return spark.read.schema(shape).format(kind).load(path).na.fill("unknown", ["annotator"])


def save_ground_truth(truth: DataFrame, path: str, kind: str = "json") -> None:
    truth.write.format(kind).save(path)
