"""The exchange in two levels gives what the plain one gives, with rows in proportion to the keys."""

import pytest
from pyspark.sql import functions as F
from test_contracts import rows

from sheetloom.llm import exchange, jaccard, ngram_lm, substring_dedup


@pytest.fixture
def docs(spark, sf_dir):
    near = spark.createDataFrame([(5000 + k, " ".join(f"u{j if j != k else -k}" for j in range(60))) for k in range(12)], "doc_id long, text string")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 60").unionAll(near).repartition(9, "doc_id")


def results(docs):
    return (
        rows(substring_dedup.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256"),
        rows(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id"),
        rows(ngram_lm.score(docs), "doc_id", "n_known", "train_tokens", "base_score", "score"),
    )


def test_two_levels_equal_one(docs, monkeypatch):
    expected = results(docs)
    assert any(r[2] for r in expected[0]) and any(r[0] != r[2] for r in expected[1])
    made = []
    inner = exchange.bucket_count
    for module in (substring_dedup, jaccard, ngram_lm):
        monkeypatch.setattr(module, "bucket_count", lambda *a: made.append(inner(*a)) or made[-1])
    monkeypatch.setattr(exchange, "FAN", 3)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 20_000)
    assert results(docs) == expected
    assert all(b.n > 6 and b.per > 2 and b.cohorts > 2 for b in made)


def test_rows_of_a_block_do_not_grow_with_the_buckets(docs, monkeypatch):
    import numpy as np

    monkeypatch.setattr(exchange, "FAN", 16)
    counts = {}
    for n_bytes in (10 << 30, 1 << 40, 100 << 40):
        buckets = exchange.bucket_count(docs.sparkSession, n_bytes)
        keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64) * 2)
        cuts = exchange._cuts(keys, exchange.Buckets(min(buckets.n, 50_000), -(-min(buckets.n, 50_000) // exchange.FAN)))
        counts[n_bytes] = int((np.diff(cuts) > 0).sum())
        # a bucket hears from cohorts, of which there is one for FAN blocks
        assert buckets.cohorts <= n_bytes // exchange.BLOCK_BYTES // exchange.FAN + 1 and -(-buckets.n // buckets.per) <= exchange.FAN
    assert max(counts.values()) <= exchange.FAN
