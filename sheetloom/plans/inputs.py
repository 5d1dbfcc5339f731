"""Inputs derived from the tables: page elements, specification texts, texts to look for patterns in, evaluation pairs; in
Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions.catalogue import Catalogue

_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: {div} is integer division.
_ELEMENTS = """
SELECT doc_id, page_number, ord, l_orderkey AS source_id, confidence, element_type, x, y, w, h, engine, priority, config,
       CASE variant WHEN 0 THEN '|' WHEN 1 THEN ' ' WHEN 2 THEN '--- x --' WHEN 3 THEN '...' ELSE coalesce(p_name, '') END AS text
FROM (
  SELECT l_partkey, l_orderkey, l_suppkey % 10 AS variant, l_orderkey % 200 AS doc_id, {page} AS page_number,
         row_number() OVER (PARTITION BY l_orderkey % 200, {page} ORDER BY {order}) AS ord,
         CAST(round(l_discount * 100) AS int) / CAST(10 AS double) AS confidence,
         CASE l_linenumber WHEN 7 THEN 'table' WHEN 6 THEN 'image' WHEN 5 THEN 'dimension' ELSE 'text' END AS element_type,
         CAST((l_partkey * 7) % 600 AS double) AS x, CAST((l_suppkey * 37) % 800 AS double) AS y,
         20 + 3 * l_quantity AS w, CAST(10 + 12 * l_linenumber AS double) AS h,
         CASE l_suppkey % 5 WHEN 0 THEN 'aws_textract' WHEN 1 THEN 'azure_ocr' WHEN 2 THEN 'tesseract' WHEN 3 THEN 'mistral_ocr' ELSE 'opencv_fallback' END AS engine,
         CASE l_suppkey % 5 WHEN 0 THEN 10 WHEN 1 THEN 15 WHEN 2 THEN 20 WHEN 3 THEN 25 ELSE 90 END AS priority,
         CAST(l_suppkey % 4 AS int) AS config
  FROM lineitem
) e LEFT JOIN part ON l_partkey = p_partkey
"""

_SPECS = """
SELECT p_partkey AS doc_id, CASE p_partkey % 4
  WHEN 0 THEN concat('Fire Rating: ', CAST(p_size % 4 + 1 AS {string}), '.5 hour', {nl}, 'UL', CAST(200 + p_partkey % 90 AS {string}), {nl}, 'sprinkler NFPA 13 fire alarm suppression fire safety fire resistance fire protection', {nl}, 'Fire Alarm: ', p_name, {nl}, 'fire alarm: ', upper(p_name))
  WHEN 1 THEN concat('Manufacturer: ', p_brand, {nl}, 'Product Data: ', p_name, {nl}, 'material properties performance', {nl}, 'ASTM A', CAST(100 + p_size AS {string}), ' Grade ', CAST(p_size AS {string}), ' Type ', CAST(p_size % 9 AS {string}), 'B', {nl}, 'Color: -- ** //', {nl}, 'Grade 5')
  WHEN 2 THEN concat('Design criteria: ', p_name, {nl}, 'Live Load: ', CAST(20 + p_size AS {string}), ' psf', {nl}, 'Deflection: L/', CAST(180 + p_size AS {string}), {nl}, 'structural foundation framing analysis calculation engineering')
  ELSE concat('SECTION 05 4000 - ', upper(p_name), ' FRAMING', {nl}, 'PART 1 GENERAL', {nl}, '1. First item, shall comply.', {nl}, '2) Second item', {nl}, {nl}, 'PART 2 PRODUCTS', {nl}, 'QUALITY ASSURANCE', {nl}, '- bullet of ', p_type, {nl}, 'Shell Permit: P', CAST(p_size AS {string}), {nl}, 'DIVISION ', CAST(p_size AS {string}), ' - METALS', {nl}, '05 12 23 - ', p_name)
END AS text FROM part
"""

#: Predictions confuse o and l with digits everywhere; a third of them lack a word wherever it stands, a third have signs too many.
_PAIRS = """
SELECT doc_id, reference, edited, translate(edited, 'ol', '01') AS predicted FROM (
  SELECT doc_id, reference, CASE doc_id % 3 WHEN 1 THEN replace(reference, ' in ', ' ') WHEN 2 THEN replace(reference, ' the ', ' the § ') ELSE reference END AS edited
  FROM (SELECT doc_id, coalesce(text, '') AS reference FROM documents) d) e
"""


def samples() -> list[tuple[int, str]]:
    """For every pattern of the catalogue a text that it matches, and one that has lost a letter of the word it needs."""
    out = []
    for k, p in enumerate(Catalogue().patterns()):
        word = next((w for w in p.needed if w in p.sample.lower()), p.sample.lower())
        at = p.sample.lower().index(word)
        out += [(2 * k, f"Item. {p.sample}\n{p.sample.upper()}"), (2 * k + 1, f"Item. {p.sample[:at]}{p.sample[at + 1 :]}")]
    return out


_SAMPLES = "SELECT * FROM (VALUES " + ", ".join("({}, {})".format(k, "'" + t.replace("'", "''") + "'") for k, t in samples()) + ") AS s(id, text)"

ELEMENTS_SQL = _ELEMENTS.format(page="(l_orderkey // 200) % 10 + 1", order=_ORDER)
SPECS_SQL = _SPECS.format(string="varchar", nl="chr(10)")
PAIRS_SQL = _PAIRS
CORPUS_SQL = f"SELECT 'spec-' || doc_id AS doc_id, text FROM ({SPECS_SQL}) p UNION ALL SELECT 'document-' || doc_id, text FROM documents UNION ALL SELECT 'sample-' || id, text FROM ({_SAMPLES}) v"


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def elements(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """apart: the parts' names are shuffled, not broadcast, for a query whose driver should hold no table."""
    sql = _ELEMENTS.format(page="(l_orderkey div 200) % 10 + 1", order=_ORDER)
    hint = "/*+ MERGE(p) */ " if apart else ""
    sql = sql.replace("SELECT doc_id", f"SELECT {hint}doc_id", 1).replace("FROM lineitem", "FROM {lineitem}").replace("JOIN part ON", "JOIN {part} AS p ON")
    return _view(spark, sf_dir, sql, "lineitem", "part")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out if it has fewer partitions than there are cores, as a small file has; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _SPECS.format(string="string", nl="char(10)")
    return spread(_view(spark, sf_dir, sql.replace("FROM part", "FROM {part}"), "part"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (a string), text of the specifications, all documents and the samples of the patterns."""
    named = lambda df, origin: df.select(F.concat(F.lit(origin + "-"), "doc_id").alias("doc_id"), "text")
    own = spark.createDataFrame(samples(), "doc_id int, text string")
    return named(specs(spark, sf_dir), "spec").unionAll(named(documents(spark, sf_dir), "document")).unionAll(named(own, "sample"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text, null as empty, in any language, beside what was made of it."""
    return spread(_view(spark, sf_dir, _PAIRS.replace("FROM documents", "FROM {documents}"), "documents").drop("edited"))
