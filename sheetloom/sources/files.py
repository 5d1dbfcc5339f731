"""Files and engine responses as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions.geometry import box_of_polygon
from sheetloom.functions.text import strip
from sheetloom.operators.elements import cell_grid, valid_tokens

EXTENSIONS, LARGEST_MB = (".pdf",), 100.0


def listed(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length of files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime", "length")


def checked(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, largest_mb: float = LARGEST_MB) -> tuple[DataFrame, DataFrame]:
    """(accepted, errors): files of an allowed extension and size; errors are path, error_class, message."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    why = F.when(~extension.isin(*extensions), "unsupported format").when(F.col("length") / 1048576 > largest_mb, "file too large")
    marked = files.withColumn("_why", why)
    return marked.where("_why is null").drop("_why"), marked.where("_why is not null").select("path", F.lit("ValidationError").alias("error_class"), F.col("_why").alias("message"))


def documents_of_pages(pages: DataFrame) -> DataFrame:
    """doc_id, total_pages, text: page texts in order, nothing between them."""
    in_order = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.array_join(F.transform(in_order, lambda p: p["text"]), "").alias("text"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, page_number, text; needs pdfplumber on the executors and a ``content`` column."""

    def read(batches):  # noqa: ANN001, ANN202
        import io

        import pandas as pd
        import pdfplumber

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    yield pd.DataFrame([(path, n, page.extract_text() or "") for n, page in enumerate(pdf.pages, 1)], columns=["path", "page_number", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, page_number int, text string")


_POINTS = "array<struct<x: double, y: double>>"


def textract(responses: DataFrame) -> DataFrame:
    """Words of responses (doc_id, page_number, width, height, response JSON): relative boxes cut to whole pixels."""
    shape = "Blocks array<struct<BlockType: string, Text: string, Confidence: double, Geometry: struct<BoundingBox: struct<Left: double, Top: double, Width: double, Height: double>>>>"
    blocks = responses.select("doc_id", "page_number", "width", "height", F.posexplode(F.from_json("response", shape)["Blocks"]).alias("ord", "b")).where("b.BlockType = 'WORD'")
    box = F.col("b.Geometry.BoundingBox")
    pixel = lambda part, size: (box[part] * F.col(size)).cast("int").cast("double")
    return blocks.select("doc_id", "page_number", "ord", strip(F.col("b.Text")).alias("text"), (F.col("b.Confidence") / 100).alias("confidence"), pixel("Left", "width").alias("x"), pixel("Top", "height").alias("y"), pixel("Width", "width").alias("w"), pixel("Height", "height").alias("h"))


def azure(responses: DataFrame) -> DataFrame:
    """Lines of responses: polygons of four points or more, confidence 0.9 where none is given."""
    shape = f"pages array<struct<lines: array<struct<content: string, confidence: double, polygon: {_POINTS}>>>>"
    lines = responses.select("doc_id", "width", "height", F.posexplode(F.from_json("response", shape)["pages"]).alias("p", "page")).select("doc_id", (F.col("p") + 1).alias("page_number"), "width", "height", F.posexplode("page.lines").alias("ord", "l"))
    found = lines.withColumn("box", box_of_polygon(F.col("l.polygon"))).where((strip(F.col("l.content")) != "") & F.col("box").isNotNull())
    pixel = lambda part, size: (F.col(f"box.{part}") * F.col(size)).cast("int").cast("double")
    return found.select("doc_id", "page_number", "ord", strip(F.col("l.content")).alias("text"), F.coalesce("l.confidence", F.lit(0.9)).alias("confidence"), pixel("x", "width").alias("x"), pixel("y", "height").alias("y"), pixel("w", "width").alias("w"), pixel("h", "height").alias("h"))


def mistral(responses: DataFrame) -> DataFrame:
    """Blocks of responses: confidence 0.8 by default; without a box, the page's top tenth; short boxes are left out."""
    shape = f"blocks array<struct<text: string, confidence: double, bbox: {_POINTS}>>"
    blocks = responses.select("doc_id", "page_number", "width", "height", F.posexplode(F.from_json("response", shape)["blocks"]).alias("ord", "b")).where(strip(F.col("b.text")) != "")
    top = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("width").cast("double").alias("w"), F.floor(F.col("height") / 10).cast("double").alias("h"))
    box = F.when(F.col("b.bbox").isNull(), top).otherwise(box_of_polygon(F.col("b.bbox")))
    return blocks.withColumn("box", box).where("box is not null").select("doc_id", "page_number", "ord", strip(F.col("b.text")).alias("text"), F.coalesce("b.confidence", F.lit(0.8)).alias("confidence"), "box.x", "box.y", "box.w", "box.h")


def tesseract(tables: DataFrame, least: float = 0.5) -> DataFrame:
    """Valid words of parallel arrays (text, conf of 0 to 100, left ... height), confidence 0 to 1. A page without any gets its
    ``page_text`` as one element over the whole of it, if that column is there, with confidence 0.5."""
    columns = ("text", "conf", "left", "top", "width", "height")
    zipped = tables.select("doc_id", "page_number", F.posexplode(F.arrays_zip(*columns)).alias("ord", "t"))
    conf = F.greatest(F.col("t.conf").cast("double"), F.lit(0.0))
    words = zipped.select("doc_id", "page_number", "ord", strip(F.col("t.text")).alias("text"), conf.alias("confidence"), *[F.col(f"t.{c}").cast("double").alias(n) for c, n in zip(columns[2:], "xywh")])
    words = valid_tokens(words, least).withColumn("confidence", F.col("confidence") / 100)
    if "page_text" not in tables.columns:
        return words
    bare = tables.join(words.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    return words.unionByName(whole_page(bare.select("doc_id", "page_number", F.col("page_text").alias("text"), F.col("page_width").alias("width"), F.col("page_height").alias("height"))))


def azure_tables(responses: DataFrame) -> DataFrame:
    """Tables of responses (doc_id, page_number, width, height, response): dense grids of their cells, boxes in whole pixels."""
    shape = f"tables array<struct<confidence: double, polygon: {_POINTS}, cells: array<struct<row_index: int, column_index: int, content: string>>>>"
    tables = responses.select("doc_id", "page_number", "width", "height", F.posexplode(F.from_json("response", shape)["tables"]).alias("table_ord", "t"))
    cells = tables.select("doc_id", "page_number", "table_ord", F.posexplode("t.cells").alias("ord", "c")).select("doc_id", "page_number", "table_ord", "ord", "c.row_index", F.col("c.column_index").alias("col_index"), "c.content")
    keys = ("doc_id", "page_number", "table_ord")
    grids = cell_grid(cells, keys).withColumns({"row_count": F.size("rows"), "column_count": F.size("headers")})
    box = box_of_polygon(F.col("t.polygon"))
    pixel = lambda part, size: (F.col(f"box.{part}") * F.col(size)).cast("int").cast("double")
    placed = tables.withColumn("box", box).select(*keys, F.coalesce("t.confidence", F.lit(0.9)).alias("confidence"), F.size("t.cells").alias("cell_count"), F.coalesce(pixel("x", "width"), F.lit(0.0)).alias("x"), F.coalesce(pixel("y", "height"), F.lit(0.0)).alias("y"), F.coalesce(pixel("w", "width"), F.col("width").cast("double")).alias("w"), F.coalesce(pixel("h", "height"), F.col("height").cast("double")).alias("h"))
    named = placed.join(grids, list(keys))
    return named.withColumn("table_id", F.concat(F.lit("azure_table_"), "table_ord"))


def whole_page(pages: DataFrame) -> DataFrame:
    """The last resort of a page: its text as one element."""
    return pages.where(strip(F.col("text")) != "").select("doc_id", "page_number", F.lit(0).alias("ord"), strip(F.col("text")).alias("text"), F.lit(0.5).alias("confidence"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
