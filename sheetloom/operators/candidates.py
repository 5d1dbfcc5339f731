"""Candidates that detectors propose: elements made of boxes, unions with their source, sizes that services accept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.functions.text import strip
from sheetloom.operators.elements import regions

# fixed values: text and confidence of what a method finds; REGIONS of detected text, TABLES of tables, OBJECTS of drawings
TABLES = {"line_table": ("[TABLE_REGION]", 0.7), "grid_table": ("[TABLE_REGION]", 0.63), "contour_table": ("[TABLE_REGION]", 0.56)}
REGIONS = {"mser": ("[DETECTED_TEXT_REGION]", 0.6), "contour": ("[DETECTED_TEXT_REGION]", 0.5), "edge": ("[DETECTED_TEXT_REGION]", 0.4)}
OBJECTS = {"dimension": ("[DIMENSION_LINE]", 0.7), "symbol": ("[TECHNICAL_SYMBOL]", 0.6), "arrow": ("[ARROW/POINTER]", 0.5)}
#: service -> least side, most side, most bytes
SERVICES = {"aws_textract": (50, 10_000, 8 << 20), "azure_ocr": (50, 10_000, None), "mistral_ocr": (32, 4_000, None)}


def element(found: DataFrame, engine: str, kind: str = "text", **metadata: str) -> DataFrame:
    """Elements of (doc_id, page_number, ord, text, confidence, x ... h): text stripped, absent sides 0, metadata with the engine."""
    own = {"ocr_engine": engine} | metadata
    pairs = F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*map(F.lit, own.values())))
    if "metadata" in found.columns:
        pairs = F.map_concat(F.map_filter(pairs, lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), k)), F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    boxless = F.coalesce("x", "y", "w", "h").isNull()
    side = lambda c: F.when(~boxless, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
    return found.select("doc_id", "page_number", "ord", strip(F.col("text")).alias("text"), F.lit(kind).alias("element_type"), "confidence", *map(side, "xywh"), pairs.alias("metadata"))


def placeholders(boxes: DataFrame, methods: dict[str, tuple[str, float]], method: str, kind: str) -> DataFrame:
    """Boxes (doc_id, page_number, ord, x ... h) as elements with the text and confidence of their method."""
    text, confidence = methods[method]
    return boxes.select("doc_id", "page_number", "ord", F.lit(text).alias("text"), F.lit(kind).alias("element_type"), F.lit(confidence).alias("confidence"), *"xywh", F.lit(method).alias("source"))


def united(*parts: DataFrame) -> DataFrame:
    """All candidates of several methods, which keep their source."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def text_regions(boxes: DataFrame) -> DataFrame:
    """What passes the filter of each method, united; boxes need page_w, page_h, area and solidity."""
    return united(*[placeholders(regions(boxes, m), REGIONS, m, "text") for m in REGIONS])


def aspect(w: Column, h: Column) -> Column:
    return F.try_divide(w, h)


def solidity(area: Column, hull: Column) -> Column:
    """Area by the area of the convex hull; 0 without a hull."""
    return F.coalesce(F.try_divide(area, hull), F.lit(0.0))


def dominant_angle(lines: DataFrame, key: str = "doc_id", angle: str = "angle") -> DataFrame:
    """key, angle (the middle of the fullest of 18 bins over [0, 180], the first among equals), confidence (its share)."""
    from sheetloom.functions.geometry import angle_bin

    counted = lines.select(key, angle_bin(F.col(angle)).alias("bin")).groupBy(key, "bin").agg(F.count("*").alias("n"))
    best = counted.groupBy(key).agg(F.max(F.struct("n", (-F.col("bin")).alias("less"))).alias("best"), F.sum("n").alias("total"))
    return best.select(key, (-F.col("best.less") * 10 + 5).cast("double").alias("angle"), (F.col("best.n") / F.col("total")).alias("confidence"))


def usable_image(width: Column, height: Column, dimensions: Column) -> Column:
    """Two or three dimensions, ten pixels a side or more, 50 million pixels at most."""
    return dimensions.isin(2, 3) & (width >= 10) & (height >= 10) & (width.cast("long") * height <= 50_000_000)


def service_size(images: DataFrame, service: str) -> DataFrame:
    """``images`` (width, height) that a service takes, with the scaled_width and scaled_height it takes them in."""
    least, most, most_bytes = SERVICES[service]
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    too_large = (w > most) | (h > most)
    if most_bytes:
        too_large = too_large | (w * h * 6 > most_bytes)
    scale = F.when(too_large, F.least(F.lit(1.0), most / w, most / h, *([F.sqrt(most_bytes / (w * h * 6))] if most_bytes else []))).otherwise(1.0)
    taken = images.where((F.col("width") >= least) & (F.col("height") >= least))
    return taken.withColumns({"scaled_width": (w * scale).cast("int"), "scaled_height": (h * scale).cast("int")})


def blank_cell(content: Column) -> Column:
    return content.isNull() | (strip(content) == "")


def numbered(boxes: DataFrame) -> DataFrame:
    """``boxes`` with their place on the page, by top and left."""
    return boxes.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("y", "x", "w", "h")))
