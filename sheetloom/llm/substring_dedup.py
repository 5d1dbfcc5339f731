"""Removal of repeated passages by difference-cover anchors.

Two equal passages of ``window`` words, wherever they start, hold an equal anchor (a shorter run of
words) at the same depth whose start is in a difference cover modulo a period in both documents.
So only the runs at cover positions are hashed and asked about; around each run that occurs twice the
match is extended to all whole windows that hold it, and those are asked about in turn, by 96 bits.

Defined cases: null or empty text has no words; a text shorter than the window keeps every word;
repeated rows count as different places; extra columns are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from sheetloom.llm import words as W
from sheetloom.llm.exchange import ask, bucket_count, cut, key_bits, packed, rows_of, text_bytes, texts_of, told, unpack, with_answers
from sheetloom.llm.shared import tidy

WINDOW = 35
#: A perfect difference set: every difference modulo the period is one of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)

ANCHORS, WINDOWS = 0, 1


def _anchors(w: W.Words, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes, of so many bits, of the runs at cover positions."""
    size = window - PERIOD + 1
    at = np.arange(len(w.hashes))
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    depth = at - w.first[:-1][text]
    at = at[np.isin(depth % PERIOD, COVER) & (at + size <= w.first[1:][text])]
    return at, cut(W.windows(w.hashes, size, at), bits)


def _candidates(w: W.Words, window: int, anchors: np.ndarray) -> np.ndarray:
    """Starts of the whole windows that hold one of these runs at a depth under the period."""
    steps = np.zeros(len(w.hashes) + 1, dtype=np.int32)
    np.add.at(steps, np.maximum(anchors - PERIOD + 1, 0), 1)
    np.add.at(steps, anchors + 1, -1)
    at = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
    # a window that begins in an earlier text than the run would pass that text's end
    return at[at + window <= w.first[1:][np.searchsorted(w.first, at, side="right") - 1]]


def _twice(kind: int, keys: list[np.ndarray], values: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], list[int]]:
    """1 for each key that another block has too, or this one more than once."""
    every = np.concatenate(keys)
    multi = np.concatenate([v[0] for v in values]).astype(bool)
    check = np.concatenate([v[1] for v in values]) if kind == WINDOWS else np.zeros(len(every), dtype=np.uint64)
    order = np.lexsort((check, every)) if kind == WINDOWS else np.argsort(every, kind="stable")
    k, c = every[order], check[order]
    same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    found = multi[order]
    found[1:] |= same
    found[:-1] |= same
    # an equal neighbour of a key that its own block has twice is found by ``same`` already
    out = np.zeros(len(every), dtype=np.uint64)
    out[order] = found
    cuts = np.cumsum([len(x) for x in keys])[:-1]
    return [[x] for x in np.split(out, cuts)], []


def substring_dedup(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` and n_words, n_removed, kept_text.

    A word goes if a window of ``window`` words that covers it also starts at any other place of the
    corpus. Words are runs without ASCII white space; kept words are joined by one space.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be more than {PERIOD} words")
    blocks = packed(docs, text_col, "dedup-blocks")
    n_bytes = text_bytes(blocks)
    n_buckets, bits = bucket_count(docs.sparkSession, n_bytes), key_bits(n_bytes, 10)

    def words(row: dict) -> tuple[pa.Table, list[bytes], W.Words]:
        table = unpack(row["payload"])
        texts = texts_of(table, text_col)
        return table, texts, W.split(texts)

    def emit_anchors(row: dict) -> list:
        _, hashes = _anchors(words(row)[2], window, bits)
        keys, counts = np.unique(hashes, return_counts=True)
        return [(ANCHORS, keys, [(counts > 1).astype(np.uint64)])]

    def places(row: dict, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        at, hashes = _anchors(w, window, bits)
        keys, index = np.unique(hashes, return_inverse=True)
        (again,) = told(row, "anchors", ANCHORS, keys, n_buckets, 1)
        at = _candidates(w, window, at[again[index] > 0])
        return at, W.windows(w.hashes, window, at)

    def emit_windows(row: dict) -> list:
        w = words(row)[2]
        at, hashes = places(row, w)
        keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        check = W.windows(w.hashes, window, at, 1)[first] >> np.uint64(32)
        return [(WINDOWS, keys, [(counts > 1).astype(np.uint64), check])]

    size = {"n_values": {ANCHORS: 1, WINDOWS: 2}, "bits": {ANCHORS: bits, WINDOWS: 64}}
    anchors = ask(blocks, emit_anchors, _twice, n_buckets, **size, name="dedup-anchors")
    asking = with_answers(blocks, anchors=anchors)
    repeated = ask(asking, emit_windows, _twice, n_buckets, **size, name="dedup-windows")

    schema = StructType([f for f in docs.schema if f.name not in ("n_words", "n_removed", "kept_text")])
    schema = schema.add("n_words", LongType()).add("n_removed", LongType()).add("kept_text", StringType())
    arrow, own = to_arrow_schema(schema), [f.name for f in schema][:-3]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            table, texts, w = words(row)
            at, hashes = places(row, w)
            keys, index = np.unique(hashes, return_inverse=True)
            (again,) = told(row, "windows", WINDOWS, keys, n_buckets, 1)
            at = at[again[index] > 0]
            steps = np.zeros(len(w.hashes) + window + 1, dtype=np.int32)
            steps[at] += 1
            np.add.at(steps, at + window, -1)
            keep = np.cumsum(steps)[: len(w.hashes)] == 0
            n = np.diff(w.first)
            total = np.concatenate([[0], np.cumsum(keep)])
            kept = total[w.first[1:]] - total[w.first[:-1]]
            out = [
                b" ".join(t.split() if k == m else compress(t.split(), keep[a : a + m])).decode()
                for t, a, m, k in zip(texts, w.first.tolist(), n.tolist(), kept.tolist())
            ]
            columns = [table.column(c).combine_chunks() for c in own]
            columns += [pa.array(n, pa.int64()), pa.array(n - kept, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([_one(c).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return with_answers(blocks, anchors=anchors, windows=repeated).mapInArrow(tidy(remove), schema)


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of what is kept."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
