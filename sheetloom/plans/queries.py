"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions import text as T
from sheetloom.functions.catalogue import Catalogue
from sheetloom.operators import candidates as K
from sheetloom.operators import elements as E
from sheetloom.operators import evaluation as V
from sheetloom.operators import patterns as P
from sheetloom.plans.inputs import CORPUS_SQL, ELEMENTS_SQL, PAIRS_SQL, SPECS_SQL, corpus, documents, elements, pairs, specs
from sheetloom.plans.errors import routed
from sheetloom.sources import files as S
from sheetloom.sources import results as R
from sheetloom.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_ELEMENTS = f"WITH elements AS MATERIALIZED ({ELEMENTS_SQL}) "
_SPECS = f"WITH specs AS ({SPECS_SQL}) "
_CORPUS = f"WITH corpus AS MATERIALIZED ({CORPUS_SQL}) "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_q(pattern)}))"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


_STRUCTURE = ", ".join(f"CAST({_count('text', p.replace('(?md)', '(?m)'))} AS int) AS {n}" for n, p in T.STRUCTURE.items())
_MEAN = rf"list_sum(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')))) / len(regexp_split_to_array(text, '[.!?]+'))"


@query(f"SELECT doc_id, {_STRUCTURE}, round({_MEAN}, 6) AS avg_sentence_length, CASE WHEN {_MEAN} > 25 THEN 'high' WHEN {_MEAN} > 15 THEN 'medium' ELSE 'low' END AS reading_complexity FROM documents")
def doc_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = T.structure(F.col("text"))
    columns["avg_sentence_length"] = F.round(columns["avg_sentence_length"], 6)
    return documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in columns.items()])


def _present(terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(low, {_q(t)}) AS int)" for t in terms) + ")"


def _best(scores: list[tuple[str, str]], default: str) -> str:
    top = "greatest(" + ", ".join(s for _, s in scores) + ")"
    return f"CASE WHEN {top} <= 0 THEN {_q(default)} " + " ".join(f"WHEN {s} = {top} THEN {_q(n)}" for n, s in scores) + " END"


def _type_score(name: str, terms: list[str]) -> str:
    more = " + ".join(f"5 * {_count('low', p)}" for p in T.TYPE_PATTERNS)
    return _present(terms) + (f" + {more}" if name == "construction_specification" else "")


_TYPE = _best([(n, _type_score(n, t)) for n, t in T.TYPE_TERMS.items()], "general")
_COMPLEXITY = _best([(n, f"{w} * {_present(t)}") for n, (w, t) in T.COMPLEXITY_TERMS.items()], "simple")
_BOTH = "(SELECT doc_id, 'spec' AS origin, text, lower(text) AS low FROM specs UNION ALL SELECT doc_id, 'document', text, lower(text) FROM documents)"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.lit("document").alias("origin"), "text")
    return specs(spark, sf_dir).select("doc_id", F.lit("spec").alias("origin"), "text").unionAll(docs)


@query(_SPECS + f"SELECT doc_id, origin, {_TYPE} AS document_type FROM {_BOTH}")
def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("doc_id", "origin", T.document_type(F.col("text")).alias("document_type"))


@query(_SPECS + f"SELECT doc_id, origin, {_COMPLEXITY} AS complexity FROM {_BOTH}")
def doc_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("doc_id", "origin", T.complexity(F.col("text")).alias("complexity"))


@query(_SPECS + "SELECT doc_id, origin, concat_ws(',', " + ", ".join(f"CASE WHEN {_present(t)} > 0 THEN {_q(n)} END" for n, t in T.LANGUAGE_TERMS.items()) + f") AS indicators FROM {_BOTH}")
def doc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("doc_id", "origin", F.array_join(T.language_indicators(F.col("text")), ",").alias("indicators"))


@query(_SPECS + "SELECT doc_id, origin, " + ", ".join(f"regexp_matches(low, {_q(p)}) AS {n}" for n, p in T.FLAGS.items()) + f" FROM {_BOTH}")
def doc_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("doc_id", "origin", *[c.alias(n) for n, c in T.flags(F.col("text")).items()])


@query(_SPECS + f"SELECT doc_id, origin, round(CASE WHEN len(ws) > 0 THEN (" + " + ".join(f"len(list_filter(ws, lambda w: contains(w, {_q(t.lower())})))" for terms in T.ENGINEERING_TERMS.values() for t in terms) + f") / len(ws) ELSE 0 END, 6) AS density FROM (SELECT *, {_words('low')} AS ws FROM {_BOTH})")
def tech_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select("doc_id", "origin", F.round(T.technical_density(F.col("text")), 6).alias("density"))


def _matches_sql(source: str) -> str:
    parts = []
    for p in Catalogue().patterns():
        find = lambda g, p=p: f"regexp_extract_all(text, {_q('(?im)' + p.pattern)}, {g})"
        if p.n_groups < 2:
            found = find(p.n_groups)
        else:
            found = f"list_transform(list_zip({find(1)}, {find(2)}), lambda z: concat_ws(' ', nullif(trim(coalesce(z[1], '')), ''), nullif(trim(coalesce(z[2], '')), '')))"
        parts.append(f"SELECT doc_id, {_q(p.category)} AS category, {p.idx} AS pattern_idx, unnest(range(len(f))) AS match_idx, unnest(f) AS raw FROM (SELECT doc_id, {found} AS f FROM {source})")
    return " UNION ALL ".join(parts)


_STRIP = r"regexp_replace(coalesce(raw, ''), '^\s+|\s+$', '', 'g')"
_CLEAN = rf"regexp_replace(trim(regexp_replace({_STRIP}, '\s+', ' ', 'g')), '^[-–—\s]+|[-–—\s]+$', '', 'g')"
_FOUND = f"""{_CORPUS}, raw AS MATERIALIZED ({_matches_sql('corpus')}), cleaned AS (
SELECT doc_id, category, pattern_idx, match_idx, {_CLEAN} AS value FROM raw WHERE length({_STRIP}) > 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category, lower(value) ORDER BY pattern_idx, match_idx) AS n FROM cleaned
WHERE length(value) > 1 AND value NOT IN ('.', ',', ';', ':', '!', '?', '-', '_', '|') AND length(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(value) >= 0.3),
found AS (SELECT doc_id, category, pattern_idx, match_idx, value FROM kept WHERE n = 1) """


@query(_FOUND + "SELECT doc_id, category, pattern_idx, CAST(match_idx AS int) AS match_idx, value FROM found")
def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.matches(corpus(spark, sf_dir))


_PLACES = "(VALUES " + ", ".join(f"({_q(name)}, {k})" for k, name in enumerate(Catalogue().categories)) + ") AS c(category, place)"
_COUNTS = f"{_FOUND}, counts AS (SELECT doc_id, category, count(*) AS n FROM raw GROUP BY ALL) "


@query(_COUNTS + f"SELECT d.doc_id, c.category, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY d.doc_id ORDER BY coalesce(n, 0) DESC, place) AS rank FROM corpus d CROSS JOIN {_PLACES} LEFT JOIN counts USING (doc_id, category) WHERE d.text <> '' QUALIFY rank <= 10")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_categories(P.statistics(corpus(spark, sf_dir))).withColumn("rank", F.col("rank").cast("long"))


@query(_COUNTS + f"SELECT d.doc_id, {len(Catalogue().patterns())} AS total_patterns, {len(Catalogue().categories)} AS categories, length(text) AS text_length, CAST(coalesce(total, 0) AS bigint) AS total_matches, round(CASE WHEN len(ws) > 0 THEN coalesce(total, 0) / len(ws) ELSE 0 END, 6) AS match_density FROM (SELECT *, {_words('text')} AS ws FROM corpus WHERE text <> '') d LEFT JOIN (SELECT doc_id, sum(n) AS total FROM counts GROUP BY ALL) USING (doc_id)")
def pattern_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.statistics(corpus(spark, sf_dir)).drop("matches_by_category").withColumn("match_density", F.round("match_density", 6))


def _titled_sql() -> str:
    parts = []
    for name, patterns in P._TITLED.items():
        lists = [f"list_zip(regexp_extract_all(text, {_q('(?im)' + p)}, 1), regexp_extract_all(text, {_q('(?im)' + p)}, 2))" for p in patterns]
        parts.append(f"SELECT doc_id, {_q(name)} AS field, unnest(range(len(f))) AS ord, unnest(f) AS z FROM (SELECT doc_id, {' || '.join(lists)} AS f FROM typed WHERE document_type = 'construction_specification')")
    return " UNION ALL ".join(parts)


_TYPED = f"{_CORPUS}, typed AS MATERIALIZED (SELECT doc_id, text, {_TYPE} AS document_type FROM (SELECT *, lower(text) AS low FROM corpus)) "


@query(_TYPED + f"SELECT doc_id, field, CAST(ord AS int) AS ord, trim(z[1]) AS number, trim(z[2]) AS title FROM ({_titled_sql()})")
def spec_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.titled(corpus(spark, sf_dir))


@query(_TYPED + "SELECT DISTINCT doc_id, field, trim(value) AS value FROM (" + " UNION ALL ".join(f"SELECT doc_id, {_q(name)} AS field, unnest(regexp_extract_all(text, {_q('(?im)' + p)}, 1)) AS value FROM typed WHERE document_type = {_q(of)}" for of, sets in P._SETS.items() for name, ps in sets.items() for p in ps) + ")")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.typed_values(corpus(spark, sf_dir))


@query(_ELEMENTS + r"SELECT doc_id, page_number, ord, text, confidence FROM elements WHERE confidence >= 0.5 AND length(trim(text)) >= 2 AND trim(text) NOT IN ('|','-','_','.',':',';','!','?') AND length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / length(text) >= 0.3")
def elements_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.readable(E.confident(elements(spark, sf_dir))).select("doc_id", "page_number", "ord", "text", "confidence")


@query(_ELEMENTS + r"SELECT doc_id, page_number, ord FROM elements WHERE confidence >= 0.5 AND trim(text) <> '' AND NOT regexp_matches(text, '^[.\-_|]+$') AND (length(trim(text)) > 1 OR confidence >= 0.7)")
def valid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = elements(spark, sf_dir).withColumn("confidence", F.col("confidence") * 100)
    return E.valid_tokens(scaled).select("doc_id", "page_number", "ord")


@query(_ELEMENTS + "SELECT doc_id, page_number, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y, x, ord) AS position FROM elements")
def elements_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.in_order(elements(spark, sf_dir)).select("doc_id", "page_number", "ord", F.col("position").cast("long"))


@query(_ELEMENTS + "SELECT doc_id, count(*) AS total_elements, count(*) FILTER (element_type = 'text') AS text_elements, count(*) FILTER (element_type = 'table') AS table_elements, count(*) FILTER (element_type = 'image') AS image_elements, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (confidence > 0.7) AS high_confidence_elements, count(*) FILTER (confidence < 0.3) AS low_confidence_elements FROM elements GROUP BY doc_id")
def element_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics(elements(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(_ELEMENTS + "SELECT doc_id, count(*) AS total_elements, max(page_number) AS pages FROM elements GROUP BY doc_id")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.page_totals(elements(spark, sf_dir))


@query(_ELEMENTS + "SELECT doc_id, page_number, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (confidence > 0.7) AS sure, sum(w * h) / 480000 AS coverage FROM elements GROUP BY ALL")
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.coverage(elements(spark, sf_dir), 480000.0)
    return found.withColumn("avg_confidence", F.round("avg_confidence", 6))


_N_PARTS = "(SELECT max(p_partkey) FROM part)"


@query(_FOUND + f", specs AS ({SPECS_SQL}), elements AS MATERIALIZED (SELECT 1 + source_id % {_N_PARTS} AS doc_id, confidence, element_type FROM ({ELEMENTS_SQL})), means AS (SELECT doc_id, coalesce(avg(CASE WHEN confidence > 0 THEN confidence END), 0) AS mean, count(*) FILTER (element_type = 'table') AS n_tables FROM elements GROUP BY doc_id), keys AS (SELECT doc_id, count(DISTINCT category) AS n_keys FROM found GROUP BY doc_id) SELECT s.doc_id, round(coalesce(mean * 0.4 + least(coalesce(n_keys, 0) / 4.0, 1) * 0.3 + least(n_tables / 5.0, 1) * 0.2 + least(length(text) / 5000.0, 1) * 0.1, 0), 6) AS confidence FROM specs s LEFT JOIN means USING (doc_id) LEFT JOIN keys ON keys.doc_id = 'spec-' || s.doc_id")
def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements go to the specifications by the number of their order, so that nearly all have some."""
    n_parts = _table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    docs, found = specs(spark, sf_dir), elements(spark, sf_dir).withColumn("doc_id", F.col("source_id") % n_parts + 1)
    keys = P.matches(docs).groupBy("doc_id").agg(F.count_distinct("category").alias("n_keys"))
    known = docs.join(keys, "doc_id", "left").na.fill(0, ["n_keys"])
    return E.document_confidence(known, found, E.of_type(found, "table")).withColumn("confidence", F.round("confidence", 6))


_INTERSECTION = "greatest(least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x), 0) * greatest(least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y), 0)"
_ON = "p.doc_id = q.doc_id AND p.page_number = q.page_number AND p.ord < q.ord"


@query(_ELEMENTS + f"SELECT * FROM (SELECT p.doc_id, p.page_number, p.ord AS a, q.ord AS b, round({_INTERSECTION} / (p.w * p.h + q.w * q.h - {_INTERSECTION}), 6) AS value FROM elements p JOIN elements q ON {_ON} AND {_INTERSECTION} > 0) WHERE value > 0.5")
def bbox_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pairs(elements(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(_ELEMENTS + f"SELECT * FROM (SELECT p.doc_id, p.page_number, p.ord AS a, q.ord AS b, round({_INTERSECTION} / least(p.w * p.h, q.w * q.h), 6) AS value FROM elements p JOIN elements q ON {_ON} AND {_INTERSECTION} > 0) WHERE value > 0.5")
def bbox_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pairs(elements(spark, sf_dir), "overlap").withColumn("value", F.round("value", 6))


def _suppressed(of: str, most: str = "") -> str:
    """One step for each element of a page, the surest first: it joins those kept unless it overlaps one of them."""
    shared = "greatest(least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x), 0) * greatest(least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y), 0)"
    box = "[{'ord': o.ord, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}]"
    return (
        _ELEMENTS.replace("WITH", "WITH RECURSIVE", 1)
        + ", o AS MATERIALIZED (SELECT doc_id, page_number, ord, x, y, w, h, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY confidence DESC, ord) AS k FROM elements)"
        + f", s AS (SELECT doc_id, page_number, k, {box} AS kept FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.page_number, o.k, CASE WHEN len(list_filter(s.kept, lambda b: {shared} / {of} > 0.5)) > 0 THEN s.kept ELSE list_concat(s.kept, {box}) END FROM s JOIN o ON o.doc_id = s.doc_id AND o.page_number = s.page_number AND o.k = s.k + 1)"
        + f" SELECT doc_id, page_number, unnest(kept{most}).ord AS ord FROM s QUALIFY k = max(k) OVER (PARTITION BY doc_id, page_number)"
    ).replace("unnest(kept).ord", "unnest(list_transform(kept, lambda b: b.ord))").replace("unnest(kept[1:50]).ord", "unnest(list_transform(kept[1:50], lambda b: b.ord))")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("doc_id", "page_number", "ord", "confidence", "x", "y", "w", "h")


@query(_suppressed("(b.w * b.h + o.w * o.h - (greatest(least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x), 0) * greatest(least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y), 0)))"))
def nms_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.suppress(_boxes(spark, sf_dir)).select("doc_id", "page_number", "ord")


@query(_suppressed("least(b.w * b.h, o.w * o.h)", "[1:50]"))
def nms_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.suppress(_boxes(spark, sf_dir), "overlap", most=50).select("doc_id", "page_number", "ord")


_ROWS = (
    _ELEMENTS.replace("WITH", "WITH RECURSIVE", 1)
    + ", o AS MATERIALIZED (SELECT doc_id, page_number, ord, x, y, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y, ord) AS k FROM elements)"
    + ", r AS (SELECT doc_id, page_number, ord, x, y, k, y AS anchor, 0 AS row_id FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.page_number, o.ord, o.x, o.y, o.k, CASE WHEN abs(o.y - anchor) > 10 THEN o.y ELSE anchor END, row_id + CASE WHEN abs(o.y - anchor) > 10 THEN 1 ELSE 0 END FROM r JOIN o ON o.doc_id = r.doc_id AND o.page_number = r.page_number AND o.k = r.k + 1) "
)


@query(_ROWS + "SELECT doc_id, page_number, ord, row_id FROM r")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rows(elements(spark, sf_dir)).select("doc_id", "page_number", "ord", "row_id")


@query(_ROWS + "SELECT doc_id, page_number, ord, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY row_id, x, y, ord) AS int) AS reading_position FROM r")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reading_order(elements(spark, sf_dir)).select("doc_id", "page_number", "ord", "reading_position")


_RUNS = "SELECT *, sum(far) OVER (PARTITION BY doc_id, page_number ORDER BY y, x, ord) AS run FROM (SELECT *, CASE WHEN {far} THEN 1 ELSE 0 END AS far FROM elements WINDOW v AS (PARTITION BY doc_id, page_number ORDER BY y, x, ord))"
_UNION = "min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h"


@query(_ELEMENTS + "SELECT doc_id, page_number, CAST(run AS bigint) AS run, coalesce(string_agg(text, ' ' ORDER BY y, x, ord) FILTER (trim(text) <> ''), '') AS text, round(avg(confidence), 6) AS confidence, count(*) AS merged_from, arg_min(element_type, ROW(y, x, ord)) AS element_type, array_to_string(list_sort(list(DISTINCT engine)), ',') AS engines, " + _UNION + " FROM (" + _RUNS.format(far="coalesce(sqrt(power(x + w / 2 - lag(x + w / 2) OVER v, 2) + power(y + h / 2 - lag(y + h / 2) OVER v, 2)) > 20, true)") + ") GROUP BY ALL")
def proximity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merge_near(elements(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6)).withColumn("engines", F.array_join("engines", ","))


@query(_ELEMENTS + "SELECT doc_id, page_number, CAST(run AS bigint) AS run, count(*) AS n_cells, round(avg(confidence) * 0.9, 9) AS confidence, " + _UNION + " FROM (" + _RUNS.format(far="coalesce(abs(y - lag(y) OVER v) > 2 * h, true)") + ") GROUP BY doc_id, page_number, run HAVING count(*) >= 4")
def grid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.grid_tables(elements(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query(_ELEMENTS + "SELECT doc_id, page_number, ord, engine FROM elements WHERE confidence >= 0.5 QUALIFY priority = min(priority) OVER (PARTITION BY doc_id, page_number)")
def engine_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fall_back(elements(spark, sf_dir)).select("doc_id", "page_number", "ord", "engine")


@query(_ELEMENTS + "SELECT doc_id, page_number, config, round(mean, 6) AS mean FROM (SELECT doc_id, page_number, config, avg(CAST(confidence * 10 AS int)) / 10 AS mean FROM elements GROUP BY ALL) WHERE mean > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY mean DESC, config) = 1")
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenths = elements(spark, sf_dir).withColumn("confidence", F.round(F.col("confidence") * 10).cast("int"))
    return E.best_config(tenths).withColumn("mean", F.round(F.col("mean") / 10, 6))


@query(_ELEMENTS + ", lines AS (SELECT doc_id, page_number, round_even(y / 20, 0) * 20 AS y_key, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM elements GROUP BY ALL), totals AS (SELECT doc_id, page_number, count(*) AS total FROM elements GROUP BY ALL) SELECT doc_id, page_number, count(*) AS n_rows, CAST(sum(n) AS bigint) AS n_cells, min(x0) AS x, min(y0) AS y, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM lines JOIN totals USING (doc_id, page_number) WHERE n > 1 AND total >= 4 GROUP BY ALL HAVING count(*) >= 2")
def aligned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.aligned_tables(elements(spark, sf_dir)).drop("rows", "confidence")


_CELLS = "SELECT l_orderkey, CAST(l_linenumber AS int) AS row_index, CAST(l_suppkey % 4 AS int) AS col_index, CAST(l_partkey AS {string}) AS content, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord FROM {lineitem}"


@query(f"WITH cells AS ({_CELLS.format(string='varchar', lineitem='lineitem')}), latest AS (SELECT l_orderkey, row_index, col_index, arg_max(content, ord) AS content FROM cells GROUP BY ALL), size AS (SELECT l_orderkey, max(row_index) AS r, max(col_index) AS c FROM latest GROUP BY ALL) SELECT s.l_orderkey, CAST(i AS int) AS row_index, CAST(j AS int) AS col_index, coalesce(content, '') AS content FROM (SELECT l_orderkey, i, unnest(range(c + 1)) AS j FROM (SELECT *, unnest(range(r + 1)) AS i FROM size)) s LEFT JOIN latest l ON s.l_orderkey = l.l_orderkey AND i = row_index AND j = col_index")
def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.sql(_CELLS.format(string="string", lineitem="{lineitem}"), lineitem=_table(spark, sf_dir, "lineitem"))
    grid = E.cell_grid(cells, ("l_orderkey",)).select("l_orderkey", F.posexplode("rows").alias("row_index", "row"))
    return grid.select("l_orderkey", "row_index", F.posexplode("row").alias("col_index", "content"))


@query("SELECT l_orderkey AS table_id, l_linenumber AS row_index, CAST(l_suppkey % 4 AS int) AS col_index, p_name AS content FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
def block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables, line items as cells, the words of part names as words."""
    lines = spark.sql("SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM {lineitem}", lineitem=_table(spark, sf_dir, "lineitem"))
    cell_id = F.concat(F.lit("c"), F.col("l_orderkey"), F.lit("-"), F.col("n"))
    null = lambda t: F.lit(None).cast(t)
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    words = parts.select(F.concat(F.lit("w"), F.col("p_partkey"), F.lit("-"), F.col("pos")).alias("id"), F.lit("WORD").alias("type"), F.col("word").alias("text"), null("int").alias("row_index"), null("int").alias("col_index"), null("array<string>").alias("child_ids"))
    named = _table(spark, sf_dir, "part").select("p_partkey", F.expr("transform(split(p_name, ' '), (x, i) -> concat('w', p_partkey, '-', i))").alias("child_ids"))
    cells = lines.join(named, F.col("l_partkey") == F.col("p_partkey")).select(cell_id.alias("id"), F.lit("CELL").alias("type"), null("string").alias("text"), F.col("l_linenumber").alias("row_index"), (F.col("l_suppkey") % 4).cast("int").alias("col_index"), "child_ids")
    orders = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(cell_id)).alias("child_ids"))
    tables = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("TABLE").alias("type"), null("string").alias("text"), null("int").alias("row_index"), null("int").alias("col_index"), "child_ids")
    found = E.block_cells(tables.unionAll(cells).unionAll(words))
    return found.select(F.col("table_id").cast("long"), "row_index", "col_index", "content")


# What a prediction changes can match nothing in the reference: it has no o and no l, words that it lacks hold neither and it
# has no digit in their place. So the fewest edits are exactly those made, and they can be counted in SQL.
_EDITS = f"""WITH pairs AS MATERIALIZED ({PAIRS_SQL}), counted AS MATERIALIZED (
SELECT doc_id, length(reference) AS n, length(reference) - length(replace(replace(reference, 'o', ''), 'l', '')) + abs(length(edited) - length(reference)) AS e,
  len(rw) AS nw, len(pw) AS mw, len(list_filter(rw, lambda w: contains(w, 'o') OR contains(w, 'l'))) AS sw
FROM (SELECT *, {_words('reference')} AS rw, {_words('predicted')} AS pw FROM pairs)),
rates AS (SELECT *, CASE WHEN n > 0 THEN e / n * 100 WHEN e > 0 THEN 100 ELSE 0 END AS cer, CASE WHEN nw > 0 THEN (sw + abs(mw - nw)) / nw * 100 WHEN mw > 0 THEN 100 ELSE 0 END AS wer FROM counted) """


@query(_EDITS + "SELECT doc_id, round(cer, 6) AS cer FROM rates")
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", F.round(V.cer("predicted", "reference"), 6).alias("cer"))


@query(_EDITS + "SELECT doc_id, round(wer, 6) AS wer FROM rates")
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.wer(pairs(spark, sf_dir)).select("doc_id", F.round("wer", 6).alias("wer"))


@query(_EDITS + "SELECT doc_id, CASE WHEN cer <= 2 AND wer <= 5 THEN 'EXCELLENT' WHEN cer <= 5 AND wer <= 10 THEN 'GOOD' WHEN cer <= 10 AND wer <= 20 THEN 'MODERATE' ELSE 'POOR' END AS grade FROM rates")
def quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = V.wer(pairs(spark, sf_dir)).withColumn("cer", V.cer("predicted", "reference"))
    return both.select("doc_id", V.grade(F.col("cer"), F.col("wer")).alias("grade"))


_GRAMS = f"""{_EDITS}, w AS (
SELECT doc_id, 0 AS side, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT doc_id, {_words('reference')} AS ws FROM pairs) UNION ALL
SELECT doc_id, 1, unnest(ws), generate_subscripts(ws, 1) FROM (SELECT doc_id, {_words('predicted')} AS ws FROM pairs)),
g AS (SELECT doc_id, side, unnest([1, 2, 3, 4]) AS n, unnest([w, w || ' ' || lead(w, 1) OVER v, w || ' ' || lead(w, 1) OVER v || ' ' || lead(w, 2) OVER v, w || ' ' || lead(w, 1) OVER v || ' ' || lead(w, 2) OVER v || ' ' || lead(w, 3) OVER v]) AS g FROM w WINDOW v AS (PARTITION BY doc_id, side ORDER BY k)),
c AS (SELECT doc_id, n, g, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS p FROM g WHERE g IS NOT NULL GROUP BY ALL),
hits AS (SELECT doc_id, n, sum(least(r, p)) AS hit, sum(p) AS p, sum(r) AS r FROM c GROUP BY ALL) """


@query(_GRAMS + "SELECT d.doc_id, round(coalesce(hit / r, 0), 6) AS rouge1 FROM counted d LEFT JOIN (SELECT * FROM hits WHERE n = 1 AND r > 0) h USING (doc_id)")
def rouge1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rouge1(pairs(spark, sf_dir), "doc_id").withColumn("rouge1", F.round("rouge1", 6))


@query(_GRAMS + "SELECT d.doc_id, round(coalesce(bleu, 0), 6) AS bleu FROM counted d LEFT JOIN (SELECT doc_id, exp(avg(ln(hit / h.p)) + least(0, 1 - any_value(nw) / any_value(mw))) AS bleu FROM hits h JOIN counted USING (doc_id) WHERE hit > 0 GROUP BY doc_id HAVING count(*) = 4) b USING (doc_id)")
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bleu(pairs(spark, sf_dir), "doc_id").withColumn("bleu", F.round("bleu", 6))


@query(_EDITS + "SELECT doc_id, round(CASE WHEN nw + mw > 0 THEN 2 * (least(nw, mw) - sw) / (nw + mw) ELSE 0 END, 6) AS rouge_l FROM counted")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", F.round(V.rouge_l("predicted", "reference"), 6).alias("rouge_l"))


@query("SELECT CAST(least(floor(a * 18 / 180), 17) AS int) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT abs(value) % 180 AS a FROM events WHERE value IS NOT NULL) GROUP BY ALL")
def angle_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = _table(spark, sf_dir, "events").where("value is not null").select((F.abs("value") % 180).alias("angle"))
    return E.angle_histogram(angles).withColumn("share", F.round("share", 6))


@query("SELECT count(*) AS total_files, count(*) FILTER (l.doc_id IS NOT NULL) AS successful, count(*) FILTER (l.doc_id IS NULL) AS failed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    docs = _table(spark, sf_dir, "documents").join(labelled, "doc_id", "left")
    return sinks.batch_report(docs.withColumn("error", F.when(F.col("known").isNull(), "no ground truth")))


@query("SELECT conv_id AS doc_id, count(*) AS total_pages, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def pages_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetloom.sources.files import documents_of_pages

    return documents_of_pages(_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text"))


@query("SELECT doc_id, concat(substr(text, 1, 500), CASE WHEN length(text) > 500 THEN '...' ELSE '' END) AS preview FROM documents")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(_ELEMENTS + "SELECT doc_id, page_number, ord FROM elements WHERE w * h > 1000 AND w > 50 AND h > 50 AND w / h < 10 AND h / w < 10")
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = elements(spark, sf_dir).withColumn("area", F.col("w") * F.col("h"))
    return E.regions(found, "line_table").select("doc_id", "page_number", "ord")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 5) AS cosine FROM (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def cosine_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    left, right = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("p")), vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("q"))
    return left.join(right, F.col("b") == F.col("a") + 1).select("a", "b", F.round(V.cosine(F.col("p"), F.col("q")), 5).alias("cosine"))


# ---- responses of engines, made of the elements of a page (600 x 800) and read back
_PAGE = ["doc_id", "page_number"]


def _responses(found: DataFrame, one: Column, name: str) -> DataFrame:
    """A response for each page: the elements in order, as JSON under ``name``."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("e")))), lambda x: x["e"])
    return found.groupBy(*_PAGE).agg(F.to_json(F.struct(listed.alias(name))).alias("response")).withColumns({"width": F.lit(600), "height": F.lit(800)})


def _polygon(sides: int = 4) -> Column:
    x, y = F.col("x") / 600, F.col("y") / 800
    right, below = (F.col("x") + F.col("w")) / 600, (F.col("y") + F.col("h")) / 800
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (right, y), (right, below), (x, below))][:sides])


_TRUNC = "trunc(x / 600 * 600) AS x, trunc(y / 800 * 800) AS y"


@query(_ELEMENTS + f"SELECT doc_id, page_number, CAST(ord - 1 AS int) AS ord, trim(text) AS text, round(confidence * 100 / 100, 6) AS confidence, {_TRUNC}, trunc(w / 600 * 600) AS w, trunc(h / 800 * 800) AS h FROM elements")
def textract_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct((F.col("x") / 600).alias("Left"), (F.col("y") / 800).alias("Top"), (F.col("w") / 600).alias("Width"), (F.col("h") / 800).alias("Height"))
    one = F.struct(F.lit("WORD").alias("BlockType"), F.col("text").alias("Text"), (F.col("confidence") * 100).alias("Confidence"), F.struct(box.alias("BoundingBox")).alias("Geometry"))
    return S.textract(_responses(elements(spark, sf_dir), one, "Blocks")).withColumn("confidence", F.round("confidence", 6))


@query(_ELEMENTS + f"SELECT doc_id, page_number, CAST(ord - 1 AS int) AS ord, trim(text) AS text, CASE WHEN ord % 4 = 0 THEN 0.9 ELSE confidence END AS confidence, {_TRUNC}, trunc(((x + w) / 600 - x / 600) * 600) AS w, trunc(((y + h) / 800 - y / 800) * 800) AS h FROM elements WHERE trim(text) <> '' AND ord % 7 <> 0")
def azure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth line has no confidence, every seventh a polygon of three points."""
    one = F.struct(F.col("text").alias("content"), F.when(F.col("ord") % 4 != 0, F.col("confidence")).alias("confidence"), F.when(F.col("ord") % 7 == 0, _polygon(3)).otherwise(_polygon()).alias("polygon"))
    pages = _responses(elements(spark, sf_dir).withColumn("doc_id", F.col("doc_id") * 100 + F.col("page_number")), one, "lines")
    wrapped = pages.withColumn("response", F.concat(F.lit('{"pages": ['), "response", F.lit("]}")))
    return S.azure(wrapped).withColumns({"page_number": (F.col("doc_id") % 100).cast("long"), "doc_id": F.floor(F.col("doc_id") / 100)})


@query(_ELEMENTS + "SELECT doc_id, page_number, CAST(ord - 1 AS int) AS ord, trim(text) AS text, CASE WHEN ord % 4 = 0 THEN 0.8 ELSE confidence END AS confidence, CASE WHEN ord % 5 = 0 THEN 0 ELSE x / 600 END AS x, CASE WHEN ord % 5 = 0 THEN 0 ELSE y / 800 END AS y, CASE WHEN ord % 5 = 0 THEN 600 ELSE (x + w) / 600 - x / 600 END AS w, CASE WHEN ord % 5 = 0 THEN 80 ELSE (y + h) / 800 - y / 800 END AS h FROM elements WHERE trim(text) <> '' AND (ord % 7 <> 0 OR ord % 5 = 0)")
def mistral_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth block has no box, every seventh one of three points."""
    bbox = F.when(F.col("ord") % 5 != 0, F.when(F.col("ord") % 7 == 0, _polygon(3)).otherwise(_polygon()))
    one = F.struct("text", F.when(F.col("ord") % 4 != 0, F.col("confidence")).alias("confidence"), bbox.alias("bbox"))
    return S.mistral(_responses(elements(spark, sf_dir), one, "blocks"))


_VALID = r"trim(text) <> '' AND NOT regexp_matches(trim(text), '^[.\-_|]+$') AND confidence >= 0.5 AND (length(trim(text)) > 1 OR confidence >= 0.7)"


@query(_ELEMENTS + f", words AS (SELECT doc_id, page_number, CAST(ord - 1 AS int) AS ord, trim(text) AS text, round(confidence, 6) AS confidence, x, y, w, h FROM elements WHERE {_VALID} AND doc_id % 5 <> 0) SELECT * FROM words UNION ALL SELECT DISTINCT doc_id, page_number, 0, 'page', 0.5, 0, 0, 600, 800 FROM elements WHERE (doc_id, page_number) NOT IN (SELECT (doc_id, page_number) FROM words)")
def tesseract_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of words; those of every fifth document are not sure enough, so its pages come as a whole."""
    found = elements(spark, sf_dir).withColumn("conf", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.round(F.col("confidence") * 100)))
    listed = F.array_sort(F.collect_list(F.struct("ord", "text", "conf", F.col("x").alias("left"), F.col("y").alias("top"), F.col("w").alias("width"), F.col("h").alias("height"))))
    pages = found.groupBy(*_PAGE).agg(listed.alias("e"))
    arrays = [F.col(f"e.{c}").alias(c) for c in ("text", "conf", "left", "top", "width", "height")]
    tables = pages.select(*_PAGE, *arrays, F.lit(" page ").alias("page_text"), F.lit(600).alias("page_width"), F.lit(800).alias("page_height"))
    return S.tesseract(tables).withColumn("confidence", F.round("confidence", 6))


@query("SELECT l_orderkey AS doc_id, count(*) AS cell_count, max(l_linenumber) + 1 AS row_count, max(l_suppkey % 4) + 1 AS column_count, 0.9::double AS confidence, trunc(0.1::double * 600) AS x, trunc(0.2::double * 800) AS y, trunc((0.5::double - 0.1::double) * 600) AS w, trunc((0.4::double - 0.2::double) * 800) AS h FROM lineitem GROUP BY l_orderkey")
def azure_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.struct(F.col("l_linenumber").alias("row_index"), (F.col("l_suppkey") % 4).alias("column_index"), F.col("l_partkey").cast("string").alias("content"))
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.1, 0.2), (0.5, 0.2), (0.5, 0.4), (0.1, 0.4))])
    table = F.struct(corners.alias("polygon"), F.sort_array(F.collect_list(cells)).alias("cells"))
    responses = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.to_json(F.struct(F.array(table).alias("tables"))).alias("response"))
    found = S.azure_tables(responses.withColumns({"page_number": F.lit(1), "width": F.lit(600), "height": F.lit(800)}))
    return found.select("doc_id", F.col("cell_count").cast("long"), F.col("row_count").cast("long"), F.col("column_count").cast("long"), "confidence", "x", "y", "w", "h")


# ---- candidates
_SIZED = "SELECT *, 600 AS page_w, 800 AS page_h, w * h AS area, (ord % 10) / 10 AS solidity, CAST(ord % 7 AS int) AS vertices FROM elements"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).withColumns({"page_w": F.lit(600), "page_h": F.lit(800), "area": F.col("w") * F.col("h"), "solidity": (F.col("ord") % 10) / 10, "vertices": (F.col("ord") % 7).cast("int")})


@query(_ELEMENTS + " UNION ALL ".join(f"SELECT doc_id, page_number, ord, '{kind}' AS kind FROM ({_SIZED}) WHERE {where}" for kind, where in E.REGION_FILTERS.items()))
def region_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sized(spark, sf_dir)
    return K.united(*[E.regions(found, kind).select("doc_id", "page_number", "ord", F.lit(kind).alias("kind")) for kind in E.REGION_FILTERS])


@query(_ELEMENTS + " UNION ALL ".join(f"SELECT doc_id, page_number, ord, '{K.REGIONS[kind][0]}' AS text, 'text' AS element_type, {K.REGIONS[kind][1]}::double AS confidence, x, y, w, h, '{kind}' AS source FROM ({_SIZED}) WHERE {E.REGION_FILTERS[kind]}" for kind in K.REGIONS))
def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.text_regions(_sized(spark, sf_dir)).withColumn("confidence", F.col("confidence").cast("double"))


@query(_ELEMENTS + "SELECT doc_id, page_number, ord, text, element_type, confidence, 'ocr' AS source FROM elements UNION ALL SELECT doc_id, page_number, ord, '[TABLE_REGION]', 'table', 0.7, 'line_table' FROM elements WHERE w * h > 1000 AND w > 50 AND h > 50 AND w / h < 10 AND h / w < 10 UNION ALL SELECT doc_id, page_number, ord, '[TABLE_REGION]', 'table', 0.56, 'contour_table' FROM (" + _SIZED + ") WHERE " + E.REGION_FILTERS["contour_table"])
def table_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised elements and what two methods take for tables, with where each comes from."""
    found = _sized(spark, sf_dir)
    tables = [K.placeholders(E.regions(found, kind), K.TABLES, kind, "table") for kind in ("line_table", "contour_table")]
    return K.united(found.withColumn("source", F.lit("ocr")), *tables).select("doc_id", "page_number", "ord", "text", "element_type", "confidence", "source")


@query(_ELEMENTS + "SELECT doc_id, page_number, ord, kind, w AS length FROM (SELECT *, 'horizontal_dimension' AS kind FROM (SELECT doc_id, page_number, ord, w, h / 16 AS h FROM elements)) WHERE w > 50 AND h < 5 UNION ALL SELECT doc_id, page_number, ord, 'vertical_dimension', h FROM (SELECT doc_id, page_number, ord, w / 16 AS w, h FROM elements) WHERE h > 50 AND w < 5")
def dimension_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = elements(spark, sf_dir)
    flat, tall = found.withColumn("h", F.col("h") / 16), found.withColumn("w", F.col("w") / 16)
    lines = E.dimension_lines(flat).where("kind = 'horizontal_dimension'").unionAll(E.dimension_lines(tall).where("kind = 'vertical_dimension'"))
    return lines.select("doc_id", "page_number", "ord", "kind", "length")


@query(_ELEMENTS + "SELECT doc_id, page_number, ord, trim(text) AS text, 'text' AS element_type, x, 0.0::double AS y, w, h, engine AS ocr_engine, CAST(ord AS varchar) AS word_num FROM elements WHERE engine = 'tesseract'")
def made_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of one engine without a top, with the caller's metadata beside the engine's name."""
    found = elements(spark, sf_dir).where("engine = 'tesseract'").withColumns({"y": F.lit(None).cast("double"), "metadata": F.map_from_arrays(F.array(F.lit("word_num")), F.array(F.col("ord").cast("string")))})
    made = K.element(found, "tesseract")
    return made.select("doc_id", "page_number", "ord", "text", "element_type", *"xywh", F.col("metadata")["ocr_engine"].alias("ocr_engine"), F.col("metadata")["word_num"].alias("word_num"))


_IMAGES = "SELECT l_orderkey, l_linenumber, l_partkey * 37 % 13000 AS width, l_suppkey * 971 % 9000 AS height, 2 + l_partkey % 3 AS dims FROM lineitem"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_IMAGES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_table(spark, sf_dir, "lineitem"))


@query(f"SELECT width, height, dims, count(*) AS n FROM ({_IMAGES}) WHERE dims IN (2, 3) AND width >= 10 AND height >= 10 AND width * height <= 50000000 GROUP BY ALL")
def usable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _images(spark, sf_dir)
    return found.where(K.usable_image(F.col("width"), F.col("height"), F.col("dims"))).groupBy("width", "height", "dims").agg(F.count("*").alias("n"))


@query(f"SELECT width, height, CAST(trunc(width * s) AS int) AS scaled_width, CAST(trunc(height * s) AS int) AS scaled_height, count(*) AS n FROM (SELECT *, CASE WHEN width > 4000 OR height > 4000 THEN least(1.0::double, 4000::double / width, 4000::double / height) ELSE 1.0::double END AS s FROM ({_IMAGES}) WHERE width >= 32 AND height >= 32) GROUP BY ALL")
def service_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.service_size(_images(spark, sf_dir), "mistral_ocr").groupBy("width", "height", "scaled_width", "scaled_height").agg(F.count("*").alias("n"))


@query("SELECT user_id AS doc_id, CAST(arg_max(bin, (n, -bin)) * 10 + 5 AS double) AS angle, round(max(n) / sum(n), 6) AS confidence FROM (SELECT user_id, CAST(least(floor(abs(value) % 180 * 18 / 180), 17) AS int) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL) GROUP BY user_id")
def dominant_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = _table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("doc_id"), (F.abs("value") % 180).alias("angle"))
    return K.dominant_angle(angles).withColumn("confidence", F.round("confidence", 6))


@query(_ELEMENTS + "SELECT doc_id, page_number, ord, round(w / h, 6) AS aspect, CASE WHEN ord % 3 = 0 THEN 0 ELSE round(w * h / (w * h + ord), 6) END AS solidity FROM elements WHERE page_number = 3")
def box_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the boxes of one page; every third has an empty hull."""
    found = E.on_page(elements(spark, sf_dir), 3)
    area = F.col("w") * F.col("h")
    hull = F.when(F.col("ord") % 3 == 0, 0.0).otherwise(area + F.col("ord"))
    return found.select("doc_id", "page_number", "ord", F.round(K.aspect(F.col("w"), F.col("h")), 6).alias("aspect"), F.round(K.solidity(area, hull), 6).alias("solidity"))


# ---- results
_CONTENT = "CASE WHEN l_partkey % 5 = 0 THEN '  ' ELSE CAST(l_partkey AS {string}) END"


@query(f"WITH cells AS (SELECT l_orderkey, l_linenumber AS r, l_suppkey % 4 AS c, {_CONTENT.format(string='varchar')} AS content, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord FROM lineitem), latest AS (SELECT l_orderkey, r, c, arg_max(content, ord) AS content FROM cells GROUP BY ALL), size AS (SELECT l_orderkey, max(r) AS rows, max(c) AS cols FROM latest GROUP BY ALL) SELECT s.l_orderkey, CASE WHEN rows >= 2 AND cols >= 1 THEN coalesce(l.content, '') END AS cell, coalesce(trim(CASE WHEN rows >= 2 AND cols >= 1 THEN coalesce(l.content, '') END) = '', true) AS blank, NULL::varchar AS outside FROM size s LEFT JOIN latest l ON s.l_orderkey = l.l_orderkey AND r = 2 AND c = 1")
def table_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell in row 2 and column 1 of every order's grid, whether it is blank, and one outside of it."""
    sql = _CELLS.format(string="string", lineitem="{lineitem}").replace("CAST(l_partkey AS string) AS content", _CONTENT.format(string="string") + " AS content")
    grid = E.cell_grid(spark.sql(sql, lineitem=_table(spark, sf_dir, "lineitem")), ("l_orderkey",))
    found = E.cell(F.col("rows"), 2, 1)
    return grid.select("l_orderkey", found.alias("cell"), K.blank_cell(found).alias("blank"), E.cell(F.col("rows"), -1, 0).alias("outside"))


@query(_ELEMENTS + "SELECT doc_id, page_number, ord, text, element_type, confidence, x, w AS width, substr(sha256(doc_id || '/' || page_number || '/' || ord), 1, 32) AS element_id, engine FROM elements")
def result_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.element_rows(elements(spark, sf_dir))
    return rows.select("doc_id", "page_number", "ord", "element.text", "element.element_type", "element.confidence", "element.bbox.x", "element.bbox.width", "element.element_id", F.col("element.metadata")["ocr_engine"].alias("engine"))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole results of the specifications, with the elements of the page they are drawn on, and their matches."""
    n_parts = _table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    docs = specs(spark, sf_dir).withColumns({"filename": F.concat(F.lit("spec."), "doc_id", F.lit(".pdf")), "total_pages": F.lit(1), "document_type": T.document_type(F.col("text"))})
    found = elements(spark, sf_dir, apart=True).withColumn("doc_id", F.col("source_id") % n_parts + 1).withColumn("page_number", F.lit(1))
    cells = spark.sql(_CELLS.format(string="string", lineitem="{lineitem}"), lineitem=_table(spark, sf_dir, "lineitem")).where(F.col("l_orderkey") <= n_parts)
    tables = E.cell_grid(cells, ("l_orderkey",)).select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("t"), "l_orderkey").alias("table_id"), "rows", "headers")
    matches = P.matches(docs)
    structured = sinks.structured_data(matches)
    keys = structured.select("doc_id", F.size("structured_data").alias("n_keys")).hint("merge")
    confidence = E.document_confidence(docs.join(keys, "doc_id", "left").na.fill(0, ["n_keys"]), found, tables)
    return R.full(docs, found, tables, structured, confidence), matches


_RESULTS = _FOUND + f", specs AS ({SPECS_SQL}), elements AS MATERIALIZED (SELECT 1 + source_id % {_N_PARTS} AS doc_id, confidence, element_type FROM ({ELEMENTS_SQL})), means AS (SELECT doc_id, count(*) AS n_elements, coalesce(avg(CASE WHEN confidence > 0 THEN confidence END), 0) AS mean FROM elements GROUP BY doc_id), keys AS (SELECT doc_id, count(DISTINCT category) AS n_keys, count(*) AS n_matches FROM found GROUP BY doc_id), grids AS (SELECT l_orderkey, (max(l_linenumber) + 1) * (max(l_suppkey % 4) + 1) AS cell_count FROM lineitem GROUP BY ALL), results AS (SELECT s.doc_id, s.text, n_elements, n_keys, n_matches, cell_count, coalesce(mean * 0.4 + least(coalesce(n_keys, 0) / 4.0, 1) * 0.3 + least((cell_count IS NOT NULL)::int / 5.0, 1) * 0.2 + least(length(text) / 5000.0, 1) * 0.1, 0) AS confidence FROM specs s LEFT JOIN means USING (doc_id) LEFT JOIN keys ON keys.doc_id = 'spec-' || s.doc_id LEFT JOIN grids ON l_orderkey = s.doc_id) "


@query(_RESULTS + "SELECT CAST(doc_id AS varchar) AS document_id, 'spec.' || doc_id || '_result.json' AS file, CASE WHEN n_elements IS NULL THEN 'pdf_text' ELSE 'hybrid' END AS processing_method, length(text) AS text_length, coalesce(n_elements, 0) AS n_elements, coalesce(n_keys, 0) AS n_categories, coalesce(cell_count, 0) AS cell_count, CAST(confidence * 1000 AS int) // 10 AS percent FROM results")
def full_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, _ = _results(spark, sf_dir)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return whole.select("document_id", sinks.result_name(F.col("filename")).alias("file"), "processing_method", F.char_length("extracted_text").alias("text_length"), F.greatest(size("elements"), F.lit(0)).cast("long").alias("n_elements"), R.n_categories().cast("long").alias("n_categories"), F.coalesce(F.get("tables", F.lit(0))["cell_count"], F.lit(0)).cast("long").alias("cell_count"), F.floor(F.col("confidence") * 100 + 1e-9).cast("int").alias("percent"))


@query(_RESULTS + "SELECT CAST(doc_id AS varchar) AS document_id, 'spec.' || doc_id || '.pdf' AS filename, coalesce(n_elements, 0) AS ocr_elements, (cell_count IS NOT NULL)::int AS tables_found, coalesce(n_matches, 0) AS patterns_matched FROM results")
def structured_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.structured_format(*_results(spark, sf_dir))
    return rows.select("document_id", "document_metadata.filename", F.col("quality_metrics.ocr_elements").cast("long").alias("ocr_elements"), F.col("quality_metrics.tables_found").cast("int").alias("tables_found"), F.col("quality_metrics.patterns_matched").cast("long").alias("patterns_matched"))


@query("SELECT CAST(doc_id AS varchar) AS doc_id, 'pdf_text' AS stage, CASE WHEN text = '' THEN 'FileCorruptedError' WHEN length(text) > 10000 THEN 'FileSizeLimitError' ELSE 'ExtractionError' END AS error_class, CASE WHEN text = '' THEN 'FileError' WHEN length(text) > 10000 THEN 'FileError' ELSE 'ProcessingError' END AS family, CASE WHEN text = '' THEN 'no text' WHEN length(text) > 10000 THEN 'too long' ELSE 'no source' END AS message FROM documents WHERE text = '' OR length(text) > 10000 OR source = 'src3'")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetloom.plans.errors import family_of

    rules = [(F.col("text") == "", "FileCorruptedError", "no text"), (F.char_length("text") > 10_000, "FileSizeLimitError", "too long"), (F.col("source") == "src3", "ExtractionError", "no source")]
    _, errors = routed(_table(spark, sf_dir, "documents"), "pdf_text", rules)
    return errors.withColumn("family", family_of(F.col("error_class")))


@query("SELECT (SELECT count(*) FROM documents) AS total_files, (SELECT count(*) FROM documents WHERE length(text) <= 1000) AS successful, (SELECT count(*) FROM documents WHERE length(text) > 1000) AS failed")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat("doc_id", F.lit(".pdf")).alias("filename"), F.lit(0.5).alias("confidence"), "text")
    good, errors = routed(docs, "pdf_text", [(F.char_length("text") > 1000, "FileSizeLimitError", "too long")], "document_id")
    summary, _, _ = R.batch(good, errors.withColumn("file", F.concat("doc_id", F.lit(".pdf"))))
    return summary


_TRUTH = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS reference_text, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'f' || doc_id END AS source_file FROM documents"


@query(f"WITH truth AS ({_TRUTH}), valid AS (SELECT * FROM truth WHERE reference_text <> '' AND source_file <> '') SELECT doc_id, quality IS NULL AS missing FROM valid LEFT JOIN labels USING (doc_id)")
def ground_truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as predictions: ground truth that is valid, and whether anything was predicted for it."""
    truth = spark.sql(_TRUTH.replace("FROM documents", "FROM {documents}"), documents=_table(spark, sf_dir, "documents"))
    pairs_, missing = V.compared(_table(spark, sf_dir, "labels"), truth)
    return pairs_.select("doc_id", F.lit(False).alias("missing")).unionAll(missing.select("doc_id", F.lit(True).alias("missing")))


_LAYOUT = ", ".join(f"CAST({_count('text', p.replace('(?md)', '(?m)'))} AS varchar) AS {n}" for n, p in T.STRUCTURE.items())
_KEYS = ", ".join(T.STRUCTURE)
_SETS_SQL = " UNION ALL ".join(f"SELECT doc_id, {_q(name)} AS key, unnest(regexp_extract_all(text, {_q('(?im)' + p)}, 1)) AS value FROM typed WHERE document_type = {_q(of)}" for of, sets in P._SETS.items() for name, ps in sets.items() for p in ps)


@query(_FOUND + _TYPED.removeprefix(_CORPUS) + f""", layout AS (SELECT doc_id, document_type, {_LAYOUT} FROM typed WHERE trim(text) <> ''),
parts AS (SELECT doc_id, category AS key, string_agg(value, '|' ORDER BY pattern_idx, match_idx) AS values FROM found GROUP BY ALL
UNION ALL SELECT doc_id, field, string_agg(trim(z[1]) || ' - ' || trim(z[2]), '|' ORDER BY ord) FROM ({_titled_sql()}) GROUP BY ALL
UNION ALL SELECT doc_id, key, string_agg(value, '|' ORDER BY value) FROM (SELECT DISTINCT doc_id, key, trim(value) AS value FROM ({_SETS_SQL})) GROUP BY ALL
UNION ALL SELECT doc_id, key, values FROM (UNPIVOT layout ON document_type, {_KEYS} INTO NAME key VALUE values))
SELECT doc_id, key, values FROM parts""")
def structured_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of every text but those whose values are fractions or classes of fractions."""
    found = P.structured(corpus(spark, sf_dir)).where(~F.col("key").isin("avg_sentence_length", "reading_complexity"))
    return found.select("doc_id", "key", F.array_join("values", "|").alias("values"))


# ---- evaluation of fields, boxes and terms
_CATEGORY_PAIRS = "SELECT p_partkey AS doc_id, list_distinct([p_brand, p_type, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END]) AS reference, [p_brand, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'x' END] AS predicted FROM part"


@query(f"SELECT doc_id, round(len(list_intersect(predicted, reference)) / len(reference), 6) AS accuracy FROM ({_CATEGORY_PAIRS})")
def field_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    reference = F.array_distinct(F.array("p_brand", "p_type", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_brand"))))
    predicted = F.array("p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("x"))
    return parts.select(F.col("p_partkey").alias("doc_id"), F.round(V.field_accuracy(predicted, reference), 6).alias("accuracy"))


@query(_ELEMENTS + "SELECT doc_id, count(*) AS n, round(avg(confidence), 6) AS mean_iou, round(avg((confidence >= 0.5)::int), 6) AS iou_at_50, round(avg((confidence >= 0.75)::int), 6) AS iou_at_75 FROM elements GROUP BY doc_id")
def iou_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences stand for the IoU of pairs."""
    found = elements(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), *V.share_columns("confidence"))
    return found.select("doc_id", "n", *[F.round(c, 6).alias(c) for c in ("mean_iou", "iou_at_50", "iou_at_75")])


@query(_ELEMENTS + ", d AS (SELECT confidence, (l % 100) / 100.0 AS iou FROM (SELECT confidence, source_id * 31 + ord * 17 AS l FROM elements)), t AS (SELECT unnest(range(50, 100, 5)) / 100.0 AS threshold), ranked AS (SELECT threshold, iou, row_number() OVER (PARTITION BY threshold ORDER BY confidence DESC, iou DESC) AS r, sum((iou >= threshold)::int) OVER (PARTITION BY threshold ORDER BY confidence DESC, iou DESC ROWS UNBOUNDED PRECEDING) AS hits FROM d, t) SELECT CAST(threshold AS double) AS threshold, round(sum(CASE WHEN iou >= threshold THEN hits / r ELSE 0 END) / 1000, 6) AS ap FROM ranked GROUP BY threshold")
def average_precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = elements(spark, sf_dir).select("confidence", ((F.col("source_id") * 31 + F.col("ord") * 17) % 100 / 100).alias("iou"))
    return V.average_precision(found, 1000).withColumn("ap", F.round("ap", 6))


@query(_SPECS + "SELECT doc_id, g AS terms, round(share, 6) AS share FROM (" + " UNION ALL ".join("SELECT doc_id, {} AS g, ({}) / ({}) AS share FROM (SELECT doc_id, lower(text) AS r, replace(lower(text), 'fire', 'f1re') AS p FROM specs) WHERE ({}) > 0".format(_q(g), " + ".join(f"(contains(r, {_q(t.lower())}) AND contains(p, {_q(t.lower())}))::int" for t in dict.fromkeys(ts)), *[" + ".join(f"contains(r, {_q(t.lower())})::int" for t in dict.fromkeys(ts))] * 2) for g, ts in T.ENGINEERING_TERMS.items()) + ")")
def technical_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions misread the word fire."""
    docs = specs(spark, sf_dir).withColumn("read", F.replace(F.lower("text"), F.lit("fire"), F.lit("f1re")))
    shares = docs.select("doc_id", F.explode(V.technical_accuracy(F.col("read"), F.col("text"))).alias("terms", "share"))
    return shares.withColumn("share", F.round("share", 6))


@query(_EDITS + "SELECT doc_id, round(0.5 * greatest(0, 100 - (cer + wer) / 2) + 0.3 * 60 + 0.2 * 50, 6) AS overall, concat_ws(',', CASE WHEN cer > 5 THEN 'improve character recognition' END, CASE WHEN wer > 10 THEN 'improve word recognition' END) AS advice FROM rates")
def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with two boxes of IoU 0.5 and 0.7 and no fields."""
    both = V.wer(pairs(spark, sf_dir)).withColumns({"cer": V.cer("predicted", "reference"), "iou_scores": F.array(F.lit(0.5), F.lit(0.7)), "field_accuracy": F.create_map().cast("map<string,double>")})
    return V.report(both).select("doc_id", F.round("overall_score", 6).alias("overall"), F.array_join("recommendations", ",").alias("advice"))


@query(f"WITH pairs AS MATERIALIZED ({PAIRS_SQL}), w AS (SELECT doc_id, list_distinct({_words('lower(predicted)')}) AS p, list_distinct({_words('lower(reference)')}) AS r FROM pairs) SELECT doc_id, round(len(list_intersect(p, r)) / nullif(len(p) + len(r) - len(list_intersect(p, r)), 0), 6) AS similarity FROM w")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", F.round(V.similarity(F.col("predicted"), F.col("reference")), 6).alias("similarity"))


_STOPS = ", ".join(_q(w) for own in V.STOP_WORDS.values() for w in own)


@query(rf"SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}{{4,}}')) AS word FROM documents) WHERE word NOT IN ({_STOPS}) GROUP BY ALL) QUALIFY rank <= 10")
def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.keywords(documents(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id, length(clean) AS n, sha256(clean) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents)")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = documents(spark, sf_dir).select("doc_id", V.clean_text(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.char_length("clean").alias("n"), F.sha2("clean", 256).alias("digest"))


@query(f"SELECT doc_id, {_best([(n, f'len(list_filter(ws, lambda w: list_contains({list(own)!r}, w)))') for n, own in V.STOP_WORDS.items()], 'unknown')} AS language FROM (SELECT doc_id, {_words('lower(text)')} AS ws FROM documents)")
def likely_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", V.likely_language(F.col("text")).alias("language"))
