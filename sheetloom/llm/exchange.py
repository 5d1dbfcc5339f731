"""Blocks of documents that ask hash-ranged buckets about their keys.

Documents are packed into blocks of a few MB and written once. A block sends each bucket its
distinct 64-bit keys as one small sorted, delta-coded row; a bucket sees every block's keys of its
hash range, resolves them together and sends each block one answer row. A key goes out once per
block whatever its frequency, so a key, copy or passage that a third of all documents hold adds
one entry per block and no bucket is larger than another; nothing is dropped. All rows can be made
again from the written blocks, so a lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager
from functools import lru_cache, reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.shared import partitions, settings, tidy, written

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
#: Buckets, or ranges of buckets, that a block sends rows to, and blocks of a cohort, about.
FAN = 2048
#: Tasks of a step at most, each with one run of rows after another.
TASKS = 50_000
BLOCKS = "payload binary, n_bytes long"
ROWS = "kind int, bucket int, block_id long, data binary"

#: Instead of a block's number: a bucket's figures, and what it stores.
FIGURES, STORED = -1, -2

#: (kind, sorted distinct keys, columns of counts beside them)
Asked = tuple[int, np.ndarray, list[np.ndarray]]


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    """Rows one by one: a row holds a block and its answers, so that a batch's rows at once would be many MB."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def texts_of(table: pa.Table, column: str) -> list[bytes]:
    """UTF-8 bytes, empty for null."""
    values = table.column(column).cast(pa.large_string()).cast(pa.large_binary())
    return pc.fill_null(values, b"").to_pylist()


def packed(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` as a written table of blocks (block_id, payload, n_bytes); every column is carried."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            rows = table.to_batches()
            payload = _ipc(rows[0] if rows else pa.RecordBatch.from_pylist([], table.schema))
            return pa.RecordBatch.from_arrays([pa.array([payload], pa.binary()), pa.array([size], pa.int64())], ["payload", "n_bytes"])

        for batch in batches:
            n = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            ends = np.cumsum(n)
            while lo < batch.num_rows:
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + BLOCK_BYTES - size, side="right")))
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1] - done)
                lo = hi
                if size >= BLOCK_BYTES or lo < batch.num_rows:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return written(df.mapInArrow(tidy(pack), BLOCKS).withColumn("block_id", F.monotonically_increasing_id()), name)


def text_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_bytes")).first()[0] or 0


class Buckets(NamedTuple):
    """How many buckets, how many of them are a range that blocks send to, and how many cohorts the blocks make."""

    n: int
    per: int = 1
    cohorts: int = 1


def bucket_count(spark: SparkSession, n_bytes: int) -> Buckets:
    """So many that a bucket's keys fit a worker, from the exact number of text bytes."""
    n = max(partitions(spark), -(-n_bytes // BUCKET_BYTES))
    if n <= FAN:
        return Buckets(n)
    return Buckets(n, -(-n // FAN), max(1, -(-n_bytes // BLOCK_BYTES // FAN)))


def key_bits(n_bytes: int, spare: int) -> int:
    """Bits of a key at which about one in ``2 ** spare`` of the keys of so many bytes of text meets another's."""
    return min(64, max(32, n_bytes.bit_length() + spare))


def cut(keys: np.ndarray, bits: int) -> np.ndarray:
    """The keys with only their leading bits."""
    return keys if bits >= 64 else keys >> np.uint64(64 - bits) << np.uint64(64 - bits)


_KINDS = (np.dtype("<u1"), np.dtype("<u1"), np.dtype("<u2"), np.dtype("<u4"), np.dtype("<u4"), *[np.dtype("<u8")] * 4)  # by bytes that are used


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, the unused high ones left out."""
    top = int(values.max()) if len(values) else 0
    used = max(1, (top.bit_length() + 7) // 8)
    raw = np.ascontiguousarray(values.astype(_KINDS[used], copy=False)).view(np.uint8).reshape(len(values), _KINDS[used].itemsize)
    return bytes([used]) + np.ascontiguousarray(raw[:, :used].T).tobytes()


def _from_planes(data: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    """Integers of the smallest type that holds them."""
    used = data[at]
    planes = np.frombuffer(data, dtype=np.uint8, count=used * n, offset=at + 1)
    if used > 1:
        kind = _KINDS[used]
        raw = np.zeros((n, kind.itemsize), dtype=np.uint8)
        raw[:, :used] = planes.reshape(used, n).T
        planes = raw.view(kind).reshape(-1)
    return planes, at + 1 + used * n


def encode(keys: np.ndarray, values: list[np.ndarray], bits: int) -> bytes:
    shifted = keys >> np.uint64(64 - bits)
    head = np.array([len(keys), shifted[0] if len(keys) else 0], dtype="<u8").tobytes()
    return head + _planes(np.diff(shifted)) + b"".join(map(_planes, values))


def decode(data: bytes, n_values: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    n, low = (int(x) for x in np.frombuffer(data, dtype="<u8", count=2))
    view, values = memoryview(data), []
    steps, at = _from_planes(view, 16, max(n - 1, 0))
    keys = np.zeros(n, dtype=np.uint64)
    if n:
        keys[0] = low
        np.cumsum(steps, dtype=np.uint64, out=keys[1:])
        keys[1:] += np.uint64(low)
    for _ in range(n_values):
        column, at = _from_planes(view, at, n)
        values.append(column)
    return keys << np.uint64(64 - bits), values


def small_batches(spark: SparkSession) -> AbstractContextManager:
    """What is written inside goes to Python in batches of at most 8 MB, or of one row."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000", spark__sql__execution__arrow__maxBytesPerBatch=str(BLOCK_BYTES))


@lru_cache
def _edges(n: int, per: int = 1) -> np.ndarray:
    """The first keys of buckets, or of ranges of ``per`` buckets, but the first."""
    return np.array([-(-(k << 64) // n) for k in range(per, n, per)], dtype=np.uint64)


def _cuts(keys: np.ndarray, buckets: Buckets) -> np.ndarray:
    """Where the keys of each range that blocks send to begin, and the number of keys."""
    return np.concatenate([[0], np.searchsorted(keys, _edges(buckets.n, buckets.per)), [len(keys)]])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block_id", pa.int64()), ("data", pa.binary())])


def ask(
    asking: DataFrame,
    emit: Callable[..., list[Asked]],
    resolve: Callable[..., tuple],
    n_buckets: Buckets,
    n_values: dict[int, int],
    bits: dict[int, int],
    name: str,
    stored: DataFrame | None = None,
) -> DataFrame:
    """One round of questions, as a written table (kind, bucket, block_id, data).

    asking:  block_id, payload and any answers of earlier rounds; each row is given to ``emit`` as a dict.
    resolve: gets a kind, the keys and the value columns of every block in one bucket and returns the
             answer columns for each block, aligned with its keys, figures for the whole bucket, and, if it
             likes, bytes to store for it.
    stored:  the stored rows of another round with as many buckets; ``resolve`` gets a bucket's bytes as well.
    Rows with block_id -1 hold a bucket's figures as 64-bit integers, those with -2 what it stores. ``bits``: leading
    bits of a key that count.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            rows = []
            for kind, keys, values in emit(row):
                cuts = _cuts(keys, n_buckets)
                for b in np.flatnonzero(np.diff(cuts)):
                    lo, hi = cuts[b], cuts[b + 1]
                    rows.append((kind, int(b), row["block_id"], encode(keys[lo:hi], [v[lo:hi] for v in values], bits[kind])))
            if rows:
                yield _batch(rows, _SCHEMA)

    looking, far = stored is not None, n_buckets.per > 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), rows in _runs(batches, "kind", "bucket"):
            kept = [rows.pop(0)["data"]] if rows[0]["block_id"] == STORED else [None]
            senders = [r["block_id"] for r in rows]  # in order: the same owner of a key in every attempt
            if not senders:
                continue
            got = [decode(rows[k].pop("data"), n_values[kind] + far, bits[kind]) for k in range(len(rows))]
            answers, figures, *own = resolve(kind, [k for k, _ in got], [v[far:] for _, v in got], *kept[:looking])
            whose = [v[:far] for _, v in got]
            del got
            # most answers are small numbers, and they are moved and held beside the blocks more than once
            out = [(kind, bucket, sender, b"".join(len(x).to_bytes(8, "little") for x in first) + _squeezed([*first, *columns])) for sender, first, columns in zip(senders, whose, answers)]
            del answers
            yield _batch([*out, (kind, bucket, FIGURES, np.array(figures, dtype="<i8").tobytes()), *((kind, bucket, STORED, x) for x in own)], _SCHEMA)

    sent = asking.mapInArrow(tidy(send), ROWS)
    more = stored.where(F.col("block_id") == STORED) if looking else None
    tasks = max(1, min(n_buckets.n, max(TASKS, partitions(asking.sparkSession))))
    task = F.floor(F.col("bucket") * tasks / n_buckets.n).cast("int")
    with small_batches(asking.sparkSession):
        if far:
            sent = _merged(sent, n_buckets, n_values, bits, name)
        asked = sent.where("bucket >= 0").unionByName(more) if looking else sent.where("bucket >= 0")
        answered = asked.repartitionById(tasks, task).sortWithinPartitions("kind", "bucket", "block_id").mapInArrow(tidy(answer), ROWS)
        if not far:
            return written(answered, name)
        return written(_returned(written(answered, f"{name}-cohorts"), sent, n_buckets), name)


def _squeezed(columns: list[np.ndarray]) -> bytes:
    return zstandard.compress(b"".join(map(_planes, columns)), 1)


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[dict[str, Any]]]]:
    """Neighbouring rows that are equal in these columns, as (their values, rows)."""
    held: list[dict[str, Any]] = []
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[n] for n in names)
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def _together(rows: DataFrame, buckets: Buckets, range_: Column, cohort: Column) -> DataFrame:
    """Rows of one range of buckets and one cohort of blocks beside each other in one task, in order of ``bucket`` and ``block_id``."""
    tasks = max(1, min(-(-buckets.n // buckets.per) * buckets.cohorts, max(TASKS, partitions(rows.sparkSession))))
    marked = rows.withColumn("run_range", range_.cast("int")).withColumn("run_cohort", cohort.cast("int"))
    dealt = marked.repartitionById(tasks, F.pmod(F.xxhash64("run_range", "run_cohort"), F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("kind", "run_range", "run_cohort", "bucket", "block_id")


def _merged(sent: DataFrame, buckets: Buckets, n_values: dict[int, int], bits: dict[int, int], name: str) -> DataFrame:
    """One row for each cohort and bucket, with a column that says which block a key is from; written.

    A row of a negative bucket -1 - range has the numbers of the cohort's blocks in that range.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, range_, cohort), rows in _runs(batches, "kind", "run_range", "run_cohort"):
            got = [decode(r["data"], n_values[kind], bits[kind]) for r in rows]
            keys = np.concatenate([k for k, _ in got])
            whose = np.repeat(np.arange(len(rows)), [len(k) for k, _ in got])
            order = np.lexsort((whose, keys))
            columns = [whose[order], *(np.concatenate([v[j] for _, v in got])[order] for j in range(n_values[kind]))]
            keys, first = keys[order], range_ * buckets.per
            inner = _edges(buckets.n)[first : min(first + buckets.per, buckets.n) - 1]
            cuts = np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]])
            out = [(kind, -1 - range_, cohort, np.array([r["block_id"] for r in rows], dtype="<i8").tobytes())]
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                out.append((kind, first + int(b), cohort, encode(keys[part], [c[part] for c in columns], bits[kind])))
            yield _batch(out, _SCHEMA)

    cohort = F.pmod(F.xxhash64("block_id"), F.lit(buckets.cohorts))
    return written(_together(sent, buckets, F.col("bucket"), cohort).mapInArrow(tidy(merge), ROWS), f"{name}-merged")


def _returned(answered: DataFrame, merged: DataFrame, buckets: Buckets) -> DataFrame:
    """The answers to cohorts as answers to blocks, a row for each range; figures and what is stored as they are."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, range_, _), rows in _runs(batches, "kind", "run_range", "run_cohort"):
            blocks = np.frombuffer(rows[0]["data"], dtype="<i8")  # the negative bucket comes first
            parts = []
            for row in rows[1:]:
                n, raw, at = int.from_bytes(row["data"][:8], "little"), memoryview(zstandard.decompress(row["data"][8:])), 0
                parts.append([])
                while at < len(raw):
                    column, at = _from_planes(raw, at, n)
                    parts[-1].append(column)
            every = [np.concatenate(x) for x in zip(*parts)]
            order = np.argsort(every[0], kind="stable")
            cuts = np.searchsorted(every[0][order], np.arange(len(blocks) + 1))
            out = [(kind, range_, int(block), _squeezed([c[order[a:b]] for c in every[1:]])) for block, a, b in zip(blocks, cuts, cuts[1:])]
            yield _batch(out, _SCHEMA)

    own, lists = answered.where("block_id >= 0"), merged.where("bucket < 0")
    range_ = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.floor(F.col("bucket") / buckets.per))
    back = _together(own.unionByName(lists), buckets, range_, F.col("block_id")).mapInArrow(tidy(give), ROWS)
    return back.unionByName(answered.where("block_id < 0"))


def with_answers(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Blocks beside what they were told: an array of (kind, bucket, data) for each round named."""
    told = [
        a.where("block_id >= 0").groupBy("block_id").agg(F.collect_list(F.struct("kind", "bucket", "data")).alias(name))
        for name, a in answers.items()
    ]
    return reduce(lambda left, right: left.join(right.hint("shuffle_hash"), "block_id", "left"), told, blocks)


def told(row: dict[str, Any], name: str, kind: int, keys: np.ndarray, n_buckets: Buckets, n_columns: int) -> list[np.ndarray]:
    """The answers about ``keys`` (sorted and distinct, as asked), as columns."""
    cuts = _cuts(keys, n_buckets)
    parts: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.uint8)] for _ in range(n_columns)]
    done = 0
    for got in sorted((g for g in row[name] or [] if g["kind"] == kind), key=lambda g: g["bucket"]):
        lo, hi = cuts[got["bucket"]], cuts[got["bucket"] + 1]
        view, at = memoryview(zstandard.decompress(got["data"])), 0
        for own in parts:
            column, at = _from_planes(view, at, int(hi - lo))
            own += [np.zeros(lo - done, dtype=np.uint8), column]
        done = hi
    return [np.concatenate([*own, np.zeros(len(keys) - done, dtype=np.uint8)]) for own in parts]


def figures(answers: DataFrame, kind: int) -> np.ndarray:
    """The sum over buckets of their figures; one short row per bucket comes to the driver."""
    rows = answers.where((F.col("block_id") == FIGURES) & (F.col("kind") == kind)).select("data").collect()
    return sum((np.frombuffer(r[0], dtype="<i8") for r in rows), np.zeros(1, dtype=np.int64))
