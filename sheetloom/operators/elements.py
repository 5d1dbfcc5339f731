"""Operators over page elements: doc_id, page_number, ord, text, element_type, confidence, x, y, w, h (null box: null x).

Order-dependent ones work within a page: windows where a row needs its neighbour alone, a fold over the page's sorted
heights where a row depends on the row before, and numpy for boxes that meet (``boxes``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sheetloom.functions import geometry as G
from sheetloom.functions.text import strip
from sheetloom.operators import boxes

PAGE = ("doc_id", "page_number")
# fixed values
NOISE = ("|", "-", "_", ".", ":", ";", "!", "?")
ENGINES = {"aws_textract": 10, "azure_ocr": 15, "tesseract": 20, "mistral_ocr": 25, "opencv_fallback": 90}
#: By these Spark knows that a function takes a group's batches one after the other.
_GROUPED = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
REGION_FILTERS = {
    "mser": "w > 10 AND h > 8 AND w < 0.8 * page_w AND h < 0.5 * page_h AND w / h > 0.1 AND w / h < 20",
    "contour": "w > 15 AND h > 8 AND area > 100 AND w < 0.9 * page_w AND h < 0.8 * page_h AND w / h > 0.1 AND w / h < 15 AND solidity > 0.5",
    "edge": "w > 20 AND h > 10 AND w < 0.7 * page_w AND w / h > 0.2 AND w / h < 10",
    "line_table": "area > 1000 AND w > 50 AND h > 50 AND w / h < 10 AND h / w < 10",
    "grid_cell": "w > 20 AND w < 0.3 * page_w AND h > 10 AND h < 0.1 * page_h AND w * h > 200 AND w / h > 0.5 AND w / h < 10",
    "contour_table": "area > 1000 AND vertices >= 4 AND w > 100 AND h > 50 AND w / h < 8 AND h / w < 8",
}


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("x", "y", "w", "h")])


def confident(elements: DataFrame, least: float = 0.5) -> DataFrame:
    return elements.where(F.col("confidence") >= least)


def readable(elements: DataFrame) -> DataFrame:
    """Without doubtful, very short, punctuation-only or mostly symbolic texts."""
    text = strip(F.col("text"))
    share = F.char_length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) / F.char_length("text")
    return elements.where((F.col("confidence") >= 0.3) & (F.char_length(text) >= 2) & ~text.isin(*NOISE) & (share >= 0.3))


def valid_tokens(elements: DataFrame, least: float = 0.5) -> DataFrame:
    """Recognised words on a 0 to 100 scale: printable, no rulers, single characters only if sure."""
    c = F.col("confidence")
    return elements.where((c >= least * 100) & (strip(F.col("text")) != "") & ~F.col("text").rlike(r"\p{Cc}") & ~F.col("text").rlike(r"^[.\-_|]+$") & ((F.char_length(strip(F.col("text"))) > 1) | (c >= 70)))


def of_type(elements: DataFrame, kind: str) -> DataFrame:
    return elements.where(F.col("element_type") == kind)


def on_page(elements: DataFrame, page: int) -> DataFrame:
    return elements.where(F.col("page_number") == page)


def regions(candidates: DataFrame, kind: str) -> DataFrame:
    return candidates.where(REGION_FILTERS[kind])


def dimension_lines(elements: DataFrame) -> DataFrame:
    flat = F.when((F.col("w") > 50) & (F.col("h") < 5), "horizontal_dimension").when((F.col("h") > 50) & (F.col("w") < 5), "vertical_dimension")
    return elements.withColumn("kind", flat).where("kind is not null").withColumn("length", F.when(F.col("kind") == "horizontal_dimension", F.col("w")).otherwise(F.col("h")))


def in_order(elements: DataFrame) -> DataFrame:
    """With ``position`` in the document: by page, top, left."""
    by = Window.partitionBy("doc_id").orderBy("page_number", F.coalesce("y", F.lit(0.0)), F.coalesce("x", F.lit(0.0)), "ord")
    return elements.withColumn("position", F.row_number().over(by))


def metrics(elements: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    found = elements.groupBy("doc_id").agg(
        F.count("*").alias("total_elements"),
        *[F.count_if(F.col("element_type") == t).alias(f"{t}_elements") for t in ("text", "table", "image")],
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(F.col("confidence") > 0.7).alias("high_confidence_elements"),
        F.count_if(F.col("confidence") < 0.3).alias("low_confidence_elements"),
    )
    return found if docs is None else docs.select("doc_id").join(found, "doc_id", "left").na.fill(0)


def page_totals(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id").agg(F.count("*").alias("total_elements"), F.max("page_number").alias("pages"))


def coverage(elements: DataFrame, page_area: float) -> DataFrame:
    return elements.groupBy(*PAGE).agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.count_if(F.col("confidence") > 0.7).alias("sure"), (F.sum(F.col("w") * F.col("h")) / page_area).alias("coverage"))


def document_confidence(docs: DataFrame, elements: DataFrame, tables: DataFrame, n_keys: str = "n_keys", categories: int = 20) -> DataFrame:
    """0.4 mean positive element confidence, 0.3 keys found, 0.2 tables, 0.1 length of text; 0 without elements.

    docs: doc_id, text, n_keys. The value is not rounded.
    """
    mean = elements.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("mean"))
    n_tables = tables.groupBy("doc_id").agg(F.count("*").alias("n_tables"))
    whole = docs.join(mean.hint("merge"), "doc_id", "left").join(n_tables.hint("merge"), "doc_id", "left")
    capped = lambda c, top: F.least(c / top, F.lit(1.0))
    score = F.col("mean") * 0.4 + capped(F.col(n_keys), max(categories * 0.2, 1)) * 0.3 + capped(F.coalesce("n_tables", F.lit(0)), 5) * 0.2 + capped(F.char_length("text"), 5000) * 0.1
    return whole.select("doc_id", F.coalesce(score, F.lit(0.0)).alias("confidence"))


def _boxed(elements: DataFrame) -> DataFrame:
    """Elements whose boxes can share an area: of four finite numbers, with width and height above 0."""
    finite = [F.abs(c) < float("inf") for c in ("x", "y", "w", "h")]
    return elements.where(reduce(Column.__and__, finite) & (F.col("w") > 0) & (F.col("h") > 0))


def _arrays(table: pa.Table, *names: str) -> np.ndarray:
    """The columns as one array of doubles, a null as a number that is none."""
    return np.stack([table[n].cast("double").to_numpy() for n in names], axis=1)


def pairs(elements: DataFrame, measure: str = "iou", above: float = 0.5, cell: float = 1024.0) -> DataFrame:
    """doc_id, page_number, a, b (ord), value for boxes of one page that meet and whose value is more than ``above`` (0 or more).

    Boxes are dealt to the cells of a grid that they lie on, so a page of many sizes is spread over many keys. A pair counts in
    the cell of its shared area's first corner alone. In a cell, ``boxes.links`` tries neighbours only.
    """
    at = lambda v: F.floor(v / cell)
    span = lambda p, n: F.explode(F.sequence(at(F.col(p)), at(F.col(p) + F.col(n))))
    dealt = _boxed(elements).select(*PAGE, "ord", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], span("x", "w").alias("cx")).select("*", span("y", "h").alias("cy"))
    keys = dealt.select(*PAGE, F.col("ord").alias("a"), F.col("ord").alias("b"), F.lit(0.0).alias("value")).schema
    shape = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in keys])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = pa.Table.from_batches(batches)
        own, ord_ = _arrays(page, "x", "y", "w", "h"), page["ord"].to_numpy()
        x, y, key = own[:, 0], own[:, 1], {n: page[n][0] for n in (*PAGE, "cx", "cy")}
        for i, j, value in boxes.links(own, own, measure, above, once=True):
            first = (np.floor(np.maximum(x[i], x[j]) / cell) == key["cx"].as_py()) & (np.floor(np.maximum(y[i], y[j]) / cell) == key["cy"].as_py()) & (ord_[i] != ord_[j])
            a, b = ord_[i[first]], ord_[j[first]]
            columns = [*(pa.repeat(key[n], len(a)) for n in PAGE), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(value[first])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)

    found.__annotations__ = _GROUPED
    return dealt.groupBy(*PAGE, "cx", "cy").applyInArrow(found, keys)


def suppress(elements: DataFrame, measure: str = "iou", above: float = 0.5, most: int | None = None) -> DataFrame:
    """Greedy suppression on each page: the surest first, without those that overlap one kept before; ``most`` a page.

    An element without a box overlaps none.
    """

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = pa.Table.from_batches(batches)
        own = _arrays(page, "x", "y", "w", "h")
        sure, known = -_arrays(page, "confidence")[:, 0], page["confidence"].is_valid().to_numpy()
        order = np.lexsort((*own.T[::-1], page["ord"].to_numpy(), sure, known))
        own = own[order]
        can = np.isfinite(own).all(axis=1) & (own[:, 2] > 0) & (own[:, 3] > 0)
        places = np.flatnonzero(can)
        stay = np.sort(np.concatenate([np.flatnonzero(~can), places[boxes.kept(own[places], measure, above, most)]]))[:most]
        yield from page.take(pa.array(order[stay])).combine_chunks().to_batches()

    left.__annotations__ = _GROUPED
    return elements.groupBy(*PAGE).applyInArrow(left, elements.schema)


def rows(elements: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """With ``row_id``: a row ends where an element is further down than ``tolerance`` from the row's first. Without a box it is at the top left.

    A fold over a page's distinct heights finds where rows begin; elements at such a height carry the row's number down.
    """
    placed = elements.withColumn("_y", F.coalesce("y", F.lit(0.0)))
    pages = placed.select(*PAGE, "_y").distinct().groupBy(*PAGE).agg(F.array_sort(F.collect_list("_y")).alias("all"))

    def step(acc: Column, y: Column) -> Column:
        return F.when((F.size(acc) == 0) | (F.abs(y - F.try_element_at(acc, F.lit(-1))) > tolerance), F.concat(acc, F.array(y))).otherwise(acc)

    firsts = pages.select(*PAGE, F.posexplode(F.aggregate("all", F.expr("cast(array() as array<double>)"), step)).alias("_row", "_y"))
    by = Window.partitionBy(*PAGE).orderBy("_y")
    marked = placed.join(firsts, [*PAGE, "_y"], "left").withColumn("row_id", F.max("_row").over(by))
    return marked.select(*elements.columns, "row_id")


def reading_order(elements: DataFrame, tolerance: float = 10.0) -> DataFrame:
    by = Window.partitionBy(*PAGE).orderBy("row_id", F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0)), "ord")
    return rows(elements, tolerance).withColumn("reading_position", F.row_number().over(by))


def merge_near(elements: DataFrame, most: float = 20.0) -> DataFrame:
    """Runs of elements (by top, left) whose centres are near the one before, as one element each.

    A run has the type of its first element and, if elements name their engines, all of those. Elements without a box
    pass through, each by itself and without a run.
    """
    by = Window.partitionBy(*PAGE).orderBy("y", "x", "ord")
    boxed = elements.where("x is not null").withColumn("_box", box())
    far = F.coalesce(G.distance(F.lag("_box").over(by), F.col("_box")) > most, F.lit(True)).cast("int")
    runs = boxed.withColumn("_far", far).withColumn("run", F.sum("_far").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("y", "x", "ord")
    texts = F.array_sort(F.collect_list(F.struct("y", "x", "ord", "text")))
    said = F.array_join(F.filter(F.transform(texts, lambda t: t["text"]), lambda t: strip(t) != ""), " ")
    more = [F.min_by("element_type", place).alias("element_type"), F.sort_array(F.collect_set("engine")).alias("engines")]
    more = [c for c, of in zip(more, ("element_type", "engine")) if of in elements.columns]
    merged = runs.groupBy(*PAGE, "run").agg(said.alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("merged_from"), *more, *_union_box())
    single = elements.where("x is null").withColumns({"run": F.lit(None).cast("long"), "merged_from": F.lit(1).cast("long")})
    if "engine" in elements.columns:
        single = single.withColumn("engines", F.array_compact(F.array("engine")))
    return merged.unionByName(single.select(*merged.columns))


def _union_box() -> list[Column]:
    x, y = F.min("x"), F.min("y")
    return [x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h")]


def grid_tables(cells: DataFrame, least: int = 4) -> DataFrame:
    """Tables of cells: a new one begins where the step down is over twice the cell's height."""
    by = Window.partitionBy(*PAGE).orderBy("y", "x", "ord")
    gap = F.coalesce(F.abs(F.col("y") - F.lag("y").over(by)) > 2 * F.col("h"), F.lit(True)).cast("int")
    runs = cells.where("x is not null").withColumn("_gap", gap).withColumn("run", F.sum("_gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*PAGE, "run").agg(F.count("*").alias("n_cells"), (F.avg("confidence") * 0.9).alias("confidence"), *_union_box()).where(F.col("n_cells") >= least)


def fall_back(elements: DataFrame, least: float = 0.5) -> DataFrame:
    """Each page's elements from the first engine by priority that has any above the threshold."""
    sure = confident(elements, least)
    return sure.withColumn("_first", F.min("priority").over(Window.partitionBy(*PAGE))).where("priority = _first").drop("_first")


def best_engine(engines: DataFrame, preferred: str | None = None) -> DataFrame:
    key = F.struct((F.col("name") != F.lit(preferred or "")).alias("other"), "priority")
    return engines.where("available").agg(F.min_by("name", key).alias("name"))


def best_config(elements: DataFrame, config: str = "config") -> DataFrame:
    """doc_id, page_number, config of the highest mean confidence above 0, the first among equals."""
    means = elements.groupBy(*PAGE, config).agg(F.avg("confidence").alias("mean"))
    by = Window.partitionBy(*PAGE).orderBy(F.desc("mean"), config)
    return means.withColumn("_n", F.row_number().over(by)).where("_n = 1 and mean > 0").drop("_n")


def aligned_tables(elements: DataFrame, step: int = 20, confidence: float = 0.6) -> DataFrame:
    """Tables of pages with four elements or more: the heights (rounded to even steps) that hold two or more."""
    boxed = elements.where("x is not null").withColumn("y_key", F.bround(F.col("y") / step) * step)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda c: c["text"])
    lines = boxed.groupBy(*PAGE, "y_key").agg(F.count("*").alias("n"), F.min("ord").alias("first"), cells.alias("cells"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    whole = lines.withColumn("total", F.sum("n").over(Window.partitionBy(*PAGE))).where("n > 1 and total >= 4")
    in_order_ = F.transform(F.array_sort(F.collect_list(F.struct("first", "cells"))), lambda r: r["cells"])
    out = whole.groupBy(*PAGE).agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_cells"), in_order_.alias("rows"), F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"))
    return out.where("n_rows >= 2").withColumn("confidence", F.lit(confidence))


def cell_grid(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, rows, headers: dense grids of (row_index, col_index, content, ord), blank where nothing is; the last wins."""
    last = cells.groupBy(*keys, "row_index", "col_index").agg(F.max_by("content", "ord").alias("content"))
    at = F.map_from_entries(F.collect_list(F.struct(F.struct("row_index", "col_index"), "content")))
    whole = last.groupBy(*keys).agg(at.alias("at"), F.max("row_index").alias("r"), F.max("col_index").alias("c"))
    grid = F.expr("transform(sequence(0, r), i -> transform(sequence(0, c), j -> coalesce(at[named_struct('row_index', cast(i as int), 'col_index', cast(j as int))], '')))")
    return whole.select(*keys, grid.alias("rows")).withColumn("headers", F.get("rows", F.lit(0)))


def cell(rows_: Column, r: int, c: int) -> Column:
    return F.get(F.get(rows_, F.lit(r)), F.lit(c)) if r >= 0 and c >= 0 else F.lit(None).cast("string")


def block_cells(blocks: DataFrame) -> DataFrame:
    """table_id, row_index, col_index, content from blocks (id, type, text, row_index, col_index, child_ids)."""
    child = lambda of: blocks.where(F.col("type") == of)
    owned = child("TABLE").select(F.col("id").alias("table_id"), F.posexplode("child_ids").alias("ord", "cell_id"))
    cells = child("CELL").select(F.col("id").alias("cell_id"), "row_index", "col_index", F.col("child_ids").alias("words"))
    spelled = owned.join(cells, "cell_id").select("table_id", "ord", "row_index", "col_index", F.posexplode_outer("words").alias("pos", "word_id"))
    words = child("WORD").select(F.col("id").alias("word_id"), "text")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), " ")
    return spelled.join(words, "word_id", "left").groupBy("table_id", "ord", "row_index", "col_index").agg(said.alias("content"))


def angle_histogram(lines: DataFrame, angle: str = "angle") -> DataFrame:
    """bin, n, share of the angles in 18 bins over [0, 180]."""
    counted = lines.select(G.angle_bin(F.col(angle)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
