"""op9: the groups of copies over the whole table."""

from sheetloom.llm import queries


def test_the_query_names_the_group_of_every_row(spark, tmp_path):
    docs = [(1, "Ab c"), (2, "x"), (3, " AB\tC "), (4, None), (5, "ab c"), (5, "x"), (6, ""), (None, "ab c")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["doc_id"], r["group_id"]) for r in queries.QUERIES["op9_fingerprint"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (2, 2), (3, 1), (4, 4), (5, 1), (5, 2), (6, 4), (None, 1)], key=repr)
