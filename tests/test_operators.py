import json
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.functions import geometry as G
from sheetloom.functions import text as T
from sheetloom.functions.catalogue import Catalogue
from sheetloom.operators import elements as E
from sheetloom.operators import evaluation as V
from sheetloom.operators import patterns as P
from sheetloom.plans.pipeline import Config, Pipeline
from sheetloom.plans.queries import QUERIES
from sheetloom.sources import files, sinks

ELEMENTS = "doc_id long, page_number int, ord long, text string, element_type string, confidence double, x double, y double, w double, h double"


def elements(spark, boxes):
    return spark.createDataFrame([(1, 1, k, f"t{k}", "text", c, *(None if v is None else float(v) for v in b)) for k, (c, b) in enumerate(boxes)], ELEMENTS)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(*values):
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xywh", values)])


def test_geometry(spark):
    touching = box(0, 0, 10, 10), box(10, 0, 10, 10)
    assert one(spark, G.intersects(*touching)) and one(spark, G.iou(*touching)) == 0
    assert one(spark, G.iou(box(0, 0, 10, 10), box(0, 0, 10, 10))) == 1
    assert one(spark, G.overlap(box(0, 0, 0, 0), box(0, 0, 5, 5))) == 0
    assert one(spark, G.overlap(box(0, 0, 10, 10), box(5, 0, 10, 5))) == 0.5
    assert one(spark, G.angle_bin(F.lit(180.0))) == 17 and one(spark, G.angle_bin(F.lit(10.0))) == 1


def test_suppression_keeps_the_surest_and_boxless(spark):
    found = elements(spark, [(0.9, (0, 0, 10, 10)), (0.8, (0, 1, 10, 10)), (0.9, (50, 50, 10, 10)), (0.1, (None,) * 4), (0.9, (0, 0, 10, 10))])
    assert sorted(r["ord"] for r in E.suppress(found).collect()) == [0, 2, 3]
    assert len(E.suppress(found, most=2).collect()) == 2


def test_suppression_leaves_no_overlapping_pair(spark, sf_dir):
    from sheetloom.plans.inputs import elements as table

    kept = E.suppress(table(spark, sf_dir))
    assert E.pairs(kept).count() == 0 < kept.count()


def test_rows_start_anew_from_their_anchor(spark):
    found = elements(spark, [(1.0, (0, y, 1, 1)) for y in (0.0, 4.0, 11.0, 12.0)])
    assert [r["row_id"] for r in E.rows(found).orderBy("ord").collect()] == [0, 0, 1, 1]
    order = E.reading_order(elements(spark, [(1.0, (9, 0, 1, 1)), (1.0, (1, 3, 1, 1)), (1.0, (0, 30, 1, 1))])).orderBy("reading_position").collect()
    assert [r["ord"] for r in order] == [1, 0, 2]


def _crowded(spark, n, tall):
    return spark.range(n).selectExpr("1L doc_id", "1 page_number", "id ord", "'t' text", "'text' element_type", "id % 11 / 10D confidence", "CAST(id * 7919 % 600 AS double) x", f"CAST(id * 104729 % {tall} AS double) y", "20D + id * 31 % 50 w", "10D + id * 17 % 7 * 12 h")


def test_rows_and_order_of_a_crowded_page(spark):
    """A fold that copied a page's rows at each element took minutes for so many; the time is that of tens of thousands of elements."""
    found = _crowded(spark, 60_000, 800)
    began = time.time()
    got = {(r["y"], r["row_id"]): r["n"] for r in E.rows(found).groupBy("y", "row_id").agg(F.count("*").alias("n")).collect()}
    assert got == {(float(y), y // 11): 75 for y in range(800)}
    last = E.reading_order(found).orderBy(F.desc("reading_position")).first()
    assert (last["reading_position"], last["row_id"]) == (60_000, 72) and time.time() - began < 30


def test_pairs_and_suppression_of_a_crowded_page(spark):
    """All against all of a cell, and a fold with an array of those kept, took minutes for so many."""
    found = _crowded(spark, 20_000, 800)
    began = time.time()
    pairs, kept = E.pairs(found), E.suppress(found)
    assert pairs.count() > 100_000 and 100 < kept.count() < 10_000 and E.pairs(kept).count() == 0
    assert pairs.where("a >= b").count() == 0 and pairs.select("a", "b").distinct().count() == pairs.count()
    assert time.time() - began < 60


def test_pairs_and_suppression_try_all_that_matters(spark):
    """Against plain loops: small cells, more elements than a block, odd boxes, a null confidence."""
    rows = [(1, k % 2, k, "", "text", [0.5, 0.9, None][k % 3], float(k * 37 % 60), k * 53 % 41 / 3, float(k * 29 % 25), k * 17 % 9 + 0.5) for k in range(120)]
    rows += [(1, 0, 200, "", "text", 0.9, 1.0, 1.0, float("nan"), 5.0), (1, 0, 201, "", "text", 0.9, 1.0, 1.0, -4.0, 5.0), (1, 0, 202, "", "text", 0.9, None, None, None, None)]
    found = spark.createDataFrame(rows, ELEMENTS)
    plain = {r[2]: r for r in rows if r[2] < 200 and r[8] > 0}

    def value(p, q, measure):
        (x, y, w, h), (u, v, s, t) = p[6:], q[6:]
        shared = max(min(x + w, u + s) - max(x, u), 0) * max(min(y + h, v + t) - max(y, v), 0)
        return shared / (w * h + s * t - shared if measure == "iou" else min(w * h, s * t))

    for measure, above in (("iou", 0.5), ("iou", 0.0), ("overlap", 0.3)):
        expected = {(a, b): value(p, q, measure) for a, p in plain.items() for b, q in plain.items() if a < b and p[1] == q[1] and value(p, q, measure) > above}
        for cell in (7.0, 1024.0):
            got = [((r["a"], r["b"]), r["value"]) for r in E.pairs(found, measure, above, cell).collect()]
            assert len(got) == len(expected) and dict(got) == expected
        kept = []
        for r in sorted(rows, key=lambda r: (r[5] is not None, -(r[5] or 0), r[2])):
            if r[2] not in plain or not any((min(k, r[2]), max(k, r[2])) in expected for k in kept):
                kept.append(r[2])
        assert sorted(r["ord"] for r in E.suppress(found, measure, above).collect()) == sorted(kept)
    from sheetloom.operators import boxes

    own = np.array([plain[k][6:] for k in sorted(plain) if plain[k][1] == 0])
    whole, boxes.BLOCK, boxes.CHUNK = boxes.kept(own, "iou", 0.3).tolist(), 5, 3
    try:
        assert boxes.kept(own, "iou", 0.3).tolist() == whole and boxes.kept(own, "iou", 0.3, 4).tolist() == whole[:4]
    finally:
        boxes.BLOCK, boxes.CHUNK = 2048, 1 << 19


def test_rows_of_equal_and_missing_heights(spark):
    found = elements(spark, [(1.0, (0, y, 1, 1)) for y in (10.0, 10.0, 20.5)] + [(1.0, (None,) * 4), (1.0, (3, -0.0, 1, 1))])
    assert [r["row_id"] for r in E.rows(found).orderBy("ord").collect()] == [0, 0, 1, 0, 0]


def test_aligned_tables_round_to_even_steps(spark):
    found = elements(spark, [(1.0, (k, y, 5, 5)) for k, y in enumerate((10.0, 1.0, 30.0, 50.0, 41.0))])
    got = E.aligned_tables(found).first()
    assert (got["n_rows"], got["n_cells"], got["rows"]) == (2, 5, [["t0", "t1"], ["t2", "t3", "t4"]])


def test_empty_elements(spark):
    none = elements(spark, [])
    for f in (E.suppress, E.rows, E.reading_order, E.merge_near, E.grid_tables, E.aligned_tables, E.pairs, E.readable, E.metrics, E.in_order):
        assert f(none).collect() == []


def test_region_and_line_filters(spark):
    found = elements(spark, [(1.0, (0, 0, 100, 3)), (1.0, (0, 0, 2, 80)), (1.0, (0, 0, 60, 60))])
    assert [(r["kind"], r["length"]) for r in E.dimension_lines(found).orderBy("ord").collect()] == [("horizontal_dimension", 100.0), ("vertical_dimension", 80.0)]
    sized = found.withColumns({"page_w": F.lit(600), "page_h": F.lit(800), "area": F.col("w") * F.col("h"), "solidity": F.lit(0.9), "vertices": F.lit(4)})
    assert {k: E.regions(sized, k).count() for k in E.REGION_FILTERS} == {"mser": 1, "contour": 1, "edge": 1, "line_table": 1, "grid_cell": 1, "contour_table": 0}


def test_engines_and_grid(spark):
    engines = spark.createDataFrame([("a", 10, False), ("b", 20, True), ("c", 30, True)], "name string, priority int, available boolean")
    assert E.best_engine(engines).first()["name"] == "b" and E.best_engine(engines, "c").first()["name"] == "c"
    cells = spark.createDataFrame([(1, 1, 1, "x", 1), (1, 1, 1, "y", 2), (1, 0, 1, "h", 3)], "t int, row_index int, col_index int, content string, ord int")
    got = E.cell_grid(cells, ("t",)).first()
    assert got["rows"] == [["", "h"], ["", "y"]] and got["headers"] == ["", "h"]


def test_catalogue():
    counts = Catalogue().counts()
    assert len(counts) == 20 and sum(counts.values()) == 287 and not Catalogue().rejected
    groups = [p.n_groups for p in Catalogue().patterns()]
    assert [groups.count(k) for k in (0, 1, 2)] == [22, 250, 15]
    own = Catalogue({})
    assert own.add("a", "x(1)") and not own.add("a", "(") and own.counts() == {"a": 1} and own.rejected == [("a", "(")]


def test_matches_are_cleaned_and_distinct(spark):
    text = "Color: Deep  Blue -\nColor: deep blue\nGrade 5\nGrade 50\nSheet: 3 of 12\nColor: -- ** //"
    got = {(r["category"], r["value"]) for r in P.matches(spark.createDataFrame([(1, text), (2, " "), (3, None)], "doc_id long, text string")).collect()}
    assert {("material_specs", "Deep Blue"), ("material_specs", "50"), ("project_info", "3 12")} <= got
    assert not {v for c, v in got if c == "material_specs"} & {"deep blue", "5", "-- ** //"}


def test_text_rules(spark):
    text = "PART 1 GENERAL\n\n1. one two. three!\n• dot\nSECTION 05 4000 - NAME"
    got = spark.createDataFrame([(text,)], "text string").select(*[c.alias(n) for n, c in T.structure(F.col("text")).items()], T.document_type(F.col("text")).alias("kind")).first().asDict()
    assert (got["paragraph_count"], got["numbered_items"], got["bullet_points"], got["kind"]) == (1, 1, 1, "construction_specification")
    assert one(spark, T.technical_density(F.lit("aws AWS word"))) == pytest.approx(4 / 3)
    assert one(spark, T.technical_density(F.lit(""))) == 0


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, "the cat sat on it", "the cat sits on it"), (2, "a b c d e", "a b c d e"), (3, "", "x y")], "id long, predicted string, reference string")
    assert [r["wer"] for r in V.wer(pairs).orderBy("id").collect()] == [20.0, 0.0, 100.0]
    assert [r["rouge1"] for r in V.rouge1(pairs, "id").orderBy("id").collect()] == [0.8, 1.0, 0.0]
    assert {r["id"]: r["bleu"] for r in V.bleu(pairs, "id").collect()} == {1: 0.0, 2: pytest.approx(1.0), 3: 0.0}
    got = pairs.select(V.rouge_l("predicted", "reference").alias("l"), V.damerau_levenshtein(F.lit("abcd"), F.lit("acbd")).alias("d"), V.normalised_cer(F.lit("abc"), F.lit("abd")).alias("c")).first()
    assert got["l"] == 0.8 and got["d"] == 1 and got["c"] == pytest.approx(100 / 3)
    assert one(spark, V.grade(F.lit(5.0), F.lit(6.0))) == "GOOD"
    doubles = lambda *v: F.lit(list(v)).cast("array<double>")
    assert one(spark, V.overall_score(F.lit(2.0), F.lit(4.0), doubles(0.5), doubles())) == pytest.approx(0.5 * 97 + 15 + 10)
    assert one(spark, V.field_accuracy(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5
    ranked = spark.createDataFrame([(0.9, 0.6), (0.8, 0.1), (0.7, 0.97)], "confidence double, iou double")
    ap = {r["threshold"]: r["ap"] for r in V.average_precision(ranked, 2).collect()}
    assert len(ap) == 10 and ap[0.5] == pytest.approx((1 + 2 / 3) / 2) and ap[0.95] == pytest.approx(1 / 6)


def test_engine_responses(spark):
    word = {"BlockType": "WORD", "Text": " Hi ", "Confidence": 90.0, "Geometry": {"BoundingBox": {"Left": 0.101, "Top": 0.5, "Width": 0.2, "Height": 0.1}}}
    responses = spark.createDataFrame([(1, 1, 100, 200, json.dumps({"Blocks": [word, {"BlockType": "LINE"}]}))], "doc_id long, page_number int, width int, height int, response string")
    r = files.textract(responses).first()
    assert (r["text"], r["confidence"], r["x"], r["y"], r["w"], r["h"]) == ("Hi", 0.9, 10.0, 100.0, 20.0, 20.0)
    square = [{"x": x, "y": y} for x, y in ((0.1, 0.1), (0.5, 0.1), (0.5, 0.2), (0.1, 0.2))]
    azure = {"pages": [{"lines": [{"content": "line", "polygon": square}, {"content": "short", "polygon": square[:3]}]}]}
    got = files.azure(responses.withColumn("response", F.lit(json.dumps(azure)))).collect()
    assert [(r["text"], r["confidence"], r["page_number"], r["x"]) for r in got] == [("line", 0.9, 1, 10.0)]
    mistral = {"blocks": [{"text": "a"}, {"text": "b", "bbox": square[:2]}, {"text": " "}]}
    got = files.mistral(responses.withColumn("response", F.lit(json.dumps(mistral)))).collect()
    assert [(r["text"], r["confidence"], r["w"], r["h"]) for r in got] == [("a", 0.8, 100.0, 20.0)]


def test_files_and_sinks(spark, tmp_path):
    for name in ("a.pdf", "b.txt", "c.PDF"):
        (tmp_path / name).write_bytes(b"x" * 10)
    good, bad = files.checked(files.listed(spark, str(tmp_path), "*"))
    assert good.count() == 2 and bad.count() == 1
    found = spark.createDataFrame([(1, "c", 1, 0, "late"), (1, "c", 0, 0, "first")], "doc_id long, category string, pattern_idx int, match_idx int, value string")
    assert sinks.structured_data(found).first()["structured_data"] == {"c": ["first", "late"]}
    for kind in ("json", "csv", "parquet"):
        sinks.write(sinks.extracted_tables(found), str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert one(spark, sinks.result_name(F.lit("a.b.pdf"))) == "a.b_result.json"


def test_pipeline_config_and_stream(spark, tmp_path, sf_dir):
    config = Config.load()
    config.set("ocr.confidence_threshold", 2)
    assert config.problems() == ["confidence threshold outside 0 to 1"] and config.get("output.formats")[0] == "json"
    pipeline = Pipeline()
    assert pipeline.remove("extract_patterns") and not pipeline.remove("extract_patterns")
    pipeline.add("first", lambda d: d.where("doc_id < 5"), 0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert pipeline.run(docs, off=("classification",)).count() == 5 and pipeline.info()[0]["name"] == "first"

    from sheetloom.streaming.documents import process

    docs.limit(10).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        process(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "state"), pipeline)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == spark.read.parquet(str(tmp_path / "in")).where("doc_id < 5").count()


def test_evaluation_reads_every_whole_document(spark, tmp_path):
    texts = [(1, "x " * 400 + "lol", "en"), (2, "größe ohne plan o", "de"), (3, None, "en"), (4, "", None), (5, "0l lO 10 o0 00", "fr"), (6, "oo 0 o", "en"), (7, "what is in the house in town in", "en"), (8, "see the tree, the the bee", "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: {r[0]: r[1] for r in QUERIES[n](spark, str(tmp_path)).collect()} for n in ("cer", "wer", "quality_grade", "rouge1", "bleu", "rouge_l")}

    def edits(p, r):
        row = list(range(len(r) + 1))
        for i, a in enumerate(p, 1):
            before, row[0] = row[0], i
            for j, b in enumerate(r, 1):
                before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for k, t, _ in texts:
        r = t or ""
        p = (r.replace(" in ", " ") if k % 3 == 1 else r.replace(" the ", " the § ") if k % 3 == 2 else r).translate(str.maketrans("ol", "01"))
        rate = lambda a, b: round(100 * edits(a, b) / len(b), 6) if b else 0.0
        c, w = rate(p, r), rate(p.split(), r.split())
        assert (got["cer"][k], got["wer"][k]) == (c, w)
        assert got["quality_grade"][k] == ("EXCELLENT" if c <= 2 and w <= 5 else "GOOD" if c <= 5 and w <= 10 else "MODERATE" if c <= 10 and w <= 20 else "POOR")
        common = sum((Counter(p.split()) & Counter(r.split())).values())
        assert got["rouge1"][k] == (round(common / len(r.split()), 6) if r.split() else 0.0)
    assert all(len(rows) == len(texts) for rows in got.values())
    assert got["rouge_l"][1] == pytest.approx(400 / 401, abs=1e-6) and got["bleu"][1] > 0.99 and got["bleu"][4] == 0


def test_bounds_and_bits_align_as_the_whole_table_does():
    import random

    rng = random.Random(7)
    for _ in range(500):
        p, r = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))) for _ in "pr")
        row, length = list(range(len(r) + 1)), [0] * (len(r) + 1)
        for i, a in enumerate(p, 1):
            before, row[0], last = row[0], i, 0
            for j, b in enumerate(r, 1):
                before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + 1)
                last, length[j] = length[j], last + 1 if a == b else max(length[j], length[j - 1])
        assert (V._edits(p, r), V._in_order(p, r)) == (row[-1], length[-1])


def test_one_walk_finds_a_real_alignment():
    import random

    rng = random.Random(5)
    for n in (3, 40, 400, 9000):
        for _ in range(6):
            r = "".join(rng.choice("abcdefgh ") for _ in range(n))
            p = "".join(c if rng.random() > 0.05 else rng.choice(["", c + "§", "1"]) for c in r)
            exact = V._edits(p, r) if n < 5000 else 0
            found = V._some_alignment(p, r, 10**9)
            assert exact <= found <= max(len(p), len(r))
            assert found < 0.2 * n + 4
            words = p.split(), r.split()
            assert V._some_alignment(*words, 10**9) >= V._edits(*words)
    assert V._some_alignment("", "abc", 9) == 3 and V._some_alignment("abc", "abc", 9) == 0
