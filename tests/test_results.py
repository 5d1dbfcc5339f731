"""Results, errors, engines, settings and candidates on small rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import elements, one

from sheetloom.functions.catalogue import Catalogue
from sheetloom.operators import candidates as K
from sheetloom.operators import elements as E
from sheetloom.operators import evaluation as V
from sheetloom.operators import patterns as P
from sheetloom.plans import errors as X
from sheetloom.plans.inputs import samples
from sheetloom.plans.pipeline import Config, Pipeline
from sheetloom.sources import engines, files, results


def test_every_pattern_of_the_catalogue_matches_its_sample(spark):
    texts = spark.createDataFrame([(k // 2, t) for k, t in samples() if k % 2 == 0], "doc_id int, text string")
    apart = Catalogue({str(k): [p.pattern] for k, p in enumerate(Catalogue().patterns())})
    counted = P.statistics(texts, apart).select("doc_id", F.get("matches_by_category", F.col("doc_id"))["n"].alias("n")).collect()
    assert len(counted) == 287 and all(r["n"] > 0 for r in counted)


def test_words_that_a_pattern_needs_fold_as_the_pattern_does(spark):
    text = "manufacturer: a1\nMANUFACTURER: a2\nſerieS: a3\nstanda\u212a SpecÍes\nfİre Dampe\u0072: a4"
    got = {r["value"] for r in P.matches(spark.createDataFrame([(1, text)], "doc_id int, text string"), only=("manufacturers", "fire_protection")).collect()}
    assert {"a1", "a2", "a3", "a4"} <= got


def test_elements_without_a_box_stay(spark):
    found = elements(spark, [(0.9, (None,) * 4), (0.8, (0, 30, 10, 10)), (0.7, (0, 5, 10, 10)), (0.6, (1, 6, 10, 10))]).withColumn("engine", F.lit("tesseract"))
    merged = E.merge_near(found).collect()
    assert sorted((r["merged_from"], r["text"], r["engines"][0]) for r in merged) == [(1, "t0", "tesseract"), (1, "t1", "tesseract"), (2, "t2 t3", "tesseract")]
    assert {r["ord"]: r["row_id"] for r in E.rows(found).collect()} == {0: 0, 2: 0, 3: 0, 1: 1}
    assert [r["ord"] for r in E.reading_order(found).orderBy("reading_position").collect()] == [0, 2, 3, 1]


def test_ties_of_categories_keep_the_order_of_the_catalogue(spark):
    own = Catalogue({"z": ["aa"], "b": ["bb"], "a": ["cc"]})
    counted = P.statistics(spark.createDataFrame([(1, "aa bb bb cc"), (2, ""), (3, None)], "doc_id int, text string"), own)
    assert [(r["category"], r["n"], r["rank"]) for r in P.top_categories(counted).orderBy("rank").collect()] == [("b", 2, 1), ("z", 1, 2), ("a", 1, 3)]
    r = counted.first()
    assert (r["total_patterns"], r["categories"], r["total_matches"], r["match_density"]) == (3, 3, 4, 1.0)


def test_later_keys_win(spark):
    text = "SECTION 05 4000 - NAME\nPART 1 GENERAL\nDIVISION 5 - METALS"
    got = {r["key"]: r["values"] for r in P.structured(spark.createDataFrame([(1, text), (2, " ")], "doc_id int, text string")).collect()}
    assert got["document_type"] == ["construction_specification"] and got["parts"] == ["1 - GENERAL"] and got["divisions"] == ["5 - METALS"]
    assert got["numbered_items"] == ["0"] and "sections" in got


def test_whole_results(spark, tmp_path):
    found = elements(spark, [(0.9, (0, 0, 10, 10)), (0.8, (None,) * 4)])
    docs = spark.createDataFrame([(1, "a.b.pdf", 2, "text here", "general"), (2, "c.pdf", 1, "", "general")], "doc_id long, filename string, total_pages int, text string, document_type string")
    tables = spark.createDataFrame([(1, "t1", [["a", "b"], ["", "d"]])], "doc_id long, table_id string, rows array<array<string>>")
    matches = spark.createDataFrame([(1, "c", 0, 0, "v"), (1, "c", 1, 0, "w")], "doc_id long, category string, pattern_idx int, match_idx int, value string")
    from sheetloom.sources.sinks import structured_data

    whole = results.full(docs, found, tables, structured_data(matches), spark.createDataFrame([(1, 0.77849)], "doc_id long, confidence double"))
    assert tuple(whole.columns) == results.KEYS
    r = whole.where("document_id = '1'").first()
    assert (r["processing_method"], r["confidence"], len(r["elements"]), r["elements"][1]["bbox"]) == ("hybrid", 0.778, 2, None)
    assert r["tables"][0]["cell_count"] == 4 and r["tables"][0]["headers"] == ["a", "b"] and r["spatial_analysis"]["total_elements"] == 2
    said = results.structured_format(whole, matches).where("document_id = '1'").first()
    assert [v["value"] for v in said["extracted_data_tables"]["c"]] == ["v", "w"] and said["quality_metrics"]["patterns_matched"] == 2
    results.write_each(whole.drop("timestamp"), str(tmp_path / "out"))
    (path,) = (tmp_path / "out" / "file=a.b_result.json").glob("*.txt")
    assert json.loads(path.read_text())["structured_data"] == {"c": ["v", "w"]}
    assert {r["document_id"]: r["categories"] for r in results.kpis(whole).collect()} == {"1": 1, "2": 0}


def test_errors_and_stages(spark):
    docs = spark.createDataFrame([(1, "ok"), (2, ""), (3, None)], "doc_id long, text string")
    stages = Pipeline([("mark", lambda d: d.withColumn("mark", F.lit(1))), ("needs_more", lambda d: d.where("no_such = 1"))])
    rules = {"mark": [(F.col("text").isNull(), "FileCorruptedError", "null"), (F.col("text") == "", "ExtractionError", "empty")]}
    left, errors, skipped = stages.run_checked(docs, {"needs_more": ("no_such",)}, rules)
    assert [r["doc_id"] for r in left.collect()] == [1] and skipped == ["needs_more"]
    assert sorted(tuple(r) for r in errors.withColumn("family", X.family_of(F.col("error_class"))).collect()) == [("2", "mark", "ExtractionError", "empty", "ProcessingError"), ("3", "mark", "FileCorruptedError", "null", "FileError")]
    assert sum(map(len, X.FAMILIES.values())) == 28 and X.family("OCRError") == "OCRError" and X.family("x") is None
    with pytest.raises(ValueError):
        X.routed(docs, "s", [(F.lit(True), "NoSuchError", "")])
    with pytest.raises(RuntimeError, match="needs_more: ProcessingError"):
        stages.run(docs.transform(X.handled("needs_more", lambda d: d.select("no_such"))))


def fakes():
    """A class of its own, which goes to workers by value."""

    class Fake:
        confidence_threshold, timeout, max_retries = 0.5, 30.0, 1

        def __init__(self, name, priority, found, usable=True, failures=0):
            self.name, self.priority, self.found, self.usable, self.failures = name, priority, found, usable, failures

        def available(self):
            return self.usable, "switched off"

        def read(self, image, page_number):
            if self.failures > 0:
                self.failures -= 1
                raise OSError("no line")
            return [{"text": f" {image.decode()} ", "confidence": c, "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0} for c in self.found]

    return Fake


def test_engines_fall_back_and_try_again(spark):
    Fake = fakes()
    registry = engines.Registry([Fake("late", 30, [0.9]), Fake("unsure", 10, [0.2]), Fake("off", 5, [0.9], usable=False)])
    assert [e.name for e in registry.available()] == ["unsure", "late"] and registry.best().name == "unsure" and registry.best("late").name == "late"
    pages = spark.createDataFrame([(1, 1, bytearray(b"hi"))], "doc_id long, page_number int, image binary")
    r = registry.read(pages, pause=0).first()
    assert (r["text"], r["engine"], r["error"]) == ("hi", "late", None)
    assert {x["name"]: x["available"] for x in registry.info(spark).collect()} == {"late": True, "unsure": True, "off": False}
    assert list(registry.problems()) == ["off"] and registry.unregister("late") and not registry.unregister("late")
    assert registry.read(pages, pause=0).first()["error"] == "unsure found nothing"
    assert len(engines.attempt(Fake("a", 1, [0.9], failures=1), b"", 1, 0)) == 1
    with pytest.raises(RuntimeError, match="no line"):
        engines.attempt(Fake("a", 1, [0.9], failures=2), b"", 1, 0)


def test_settings_come_in_layers(tmp_path, monkeypatch):
    monkeypatch.setenv("TESSERACT_CMD", "/bin/t")
    monkeypatch.setenv("REDIS_PORT", "77")
    monkeypatch.chdir(tmp_path)
    (tmp_path / "given.json").write_text(json.dumps({"ocr": {"max_retries": 5, "tesseract_cmd": "/given"}, "cache": {"enabled": True}}))
    (tmp_path / "config.json").write_text(json.dumps({"ocr": {"tesseract_cmd": "/last"}}))
    config = Config.load(str(tmp_path / "given.json"))
    assert (config.get("ocr.tesseract_cmd"), config.get("ocr.max_retries"), config.get("cache.redis_port"), config.get("cache.enabled")) == ("/last", 5, 77, True)
    assert config.problems() == []
    for path, value in (("ocr.preferred_engine", "aws_textract"), ("logging.file_path", "/no/such/folder/x.log"), ("output.default_format", "xml")):
        config.set(path, value)
    assert len(config.problems()) == 3


def test_candidates(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 5.0, None, 3.0, 2.0, {"a": "b"}), (1, 1, 2, None, None, None, None, None)], "doc_id long, page_number int, ord long, x double, y double, w double, h double, metadata map<string,string>")
    made = K.element(boxes.withColumns({"text": F.lit(" t "), "confidence": F.lit(0.5)}), "opencv_fallback", method="edge").orderBy("ord").collect()
    assert made[0]["metadata"] == {"ocr_engine": "opencv_fallback", "method": "edge", "a": "b"} and (made[0]["text"], made[0]["y"]) == ("t", 0.0)
    assert made[1]["x"] is None and made[1]["metadata"]["method"] == "edge"
    lines = spark.createDataFrame([(1, 5.0), (1, 12.0), (1, 15.0), (1, 1.0), (2, 180.0)], "doc_id long, angle double")
    assert {r["doc_id"]: (r["angle"], r["confidence"]) for r in K.dominant_angle(lines).collect()} == {1: (5.0, 0.5), 2: (175.0, 1.0)}
    assert one(spark, K.blank_cell(F.lit(" \t"))) and one(spark, K.blank_cell(F.lit(None).cast("string"))) and not one(spark, K.blank_cell(F.lit("x")))


def test_distances():
    def table(p, r):
        d = [[i + j if not i * j else 0 for j in range(len(r) + 1)] for i in range(len(p) + 1)]
        for i in range(1, len(p) + 1):
            for j in range(1, len(r) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (p[i - 1] != r[j - 1]))
                if i > 1 and j > 1 and p[i - 1] == r[j - 2] and p[i - 2] == r[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = np.random.default_rng(3)
    for _ in range(300):
        p, r = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in "pr")
        assert V._swaps(V._points(p), V._points(r), {}) == table(p, r), (p, r)
    assert V._swaps(V._points("1ook"), V._points("look"), {(ord("1"), ord("l")): 0.25}) == 0.25


def test_more_of_evaluation(spark):
    truth = spark.createDataFrame([(1, "a", "f"), (2, "", "f"), (3, "b", "f")], "doc_id long, reference_text string, source_file string")
    pairs, missing = V.compared(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, predicted string"), truth)
    assert [r["doc_id"] for r in pairs.collect()] == [1] and [r["doc_id"] for r in missing.collect()] == [3]
    matches = lambda *v: spark.createDataFrame([(1, "c", x) for x in v], "doc_id long, category string, value string")
    assert V.match_rate(matches("A", "z"), matches("a", "b")).first()["match_rate"] == 0.5
    assert one(spark, V.likely_language(F.lit("der Hund und die Katze"))) == "de" and one(spark, V.likely_language(F.lit("42"))) == "unknown"
    assert one(spark, V.clean_text(F.lit(" a\n\u00a0b\u0007 "))) == "a b"


def test_token_arrays_and_stubbed_pages(spark, tmp_path, monkeypatch):
    shape = "doc_id long, page_number int, text array<string>, conf array<string>, left array<int>, top array<int>, width array<int>, height array<int>, page_text string, page_width int, page_height int"
    tables = spark.createDataFrame([(1, 1, ["ok", "||", " ", "x", "I"], ["90", "95", "99", "60", "75"], [1] * 5, [2] * 5, [3] * 5, [4] * 5, "page", 600, 800), (1, 2, ["no"], ["-1"], [0], [0], [0], [0], " whole page ", 600, 800), (1, 3, [], [], [], [], [], [], " ", 600, 800)], shape)
    got = sorted((r["page_number"], r["text"], r["confidence"], r["w"]) for r in files.tesseract(tables).collect())
    assert got == [(1, "I", 0.75, 3.0), (1, "ok", 0.9, 3.0), (2, "whole page", 0.5, 600.0)]
    # a stand-in for the PDF library, which is not installed here
    (tmp_path / "pdfplumber.py").write_text("class P:\n    def __init__(self, t): self.t = t\n    def extract_text(self): return self.t or None\nclass D:\n    def __init__(self, f): self.pages = [P(t) for t in f.read().decode().split('|')]\n    def __enter__(self): return self\n    def __exit__(self, *a): pass\ndef open(f): return D(f)\n")
    spark.sparkContext.addPyFile(str(tmp_path / "pdfplumber.py"))
    pages = files.pdf_pages(spark.createDataFrame([("a.pdf", bytearray(b"one||two"))], "path string, content binary"))
    assert [(r["page_number"], r["text"]) for r in pages.orderBy("page_number").collect()] == [(1, "one"), (2, ""), (3, "two")]
    assert files.documents_of_pages(pages.withColumnRenamed("path", "doc_id")).first()["text"] == "onetwo"


def test_error_rates_stream(spark, tmp_path):
    from sheetloom.streaming.documents import error_rates

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts, double(id) AS cer, double(2 * id) AS wer FROM range(10)")
    got = error_rates(rows).orderBy("window").collect()
    assert [(r["n"], r["cer"], r["wer"]) for r in got] == [(5, 2.0, 4.0), (5, 7.0, 14.0)]


def test_whole_results_hold_no_table_in_the_driver(spark, sf_dir):
    from sheetloom.plans.queries import QUERIES

    plan = QUERIES["full_results"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan and plan.count("posexplode") <= 4
