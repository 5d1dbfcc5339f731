"""Token ids in files of wavelet matrices.

A segment holds the ids of consecutive documents as one bit-plane per bit of the vocabulary, each
reordered stably by the bits before it, with a directory of counts for rank and select. So a token at a
place, the occurrences of an id in a range and the place of its k-th occurrence are each found in as many
steps as there are bits. Planes are compressed in blocks of 32 KB and a step inflates one block, not the rest.
Shards are ranges of the document id; a shard's part file holds its segments in order, and ``tokens_at``,
``count_token`` and ``occurrence`` answer for a whole store from its segments' places and counts.
Spark's writer commits the files, so a task that is run again leaves one copy.

Defined cases: null or empty text has its end id alone; a null document id comes before all others and is read
back as null; equal ids stand in the order of their token ids; a document longer than a segment is a segment of its
own; an empty table gives an empty store; further columns are left out; ids that are no integers are refused.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sheetloom.llm.bpe import Pieces, pattern
from sheetloom.llm.shared import gone_at_exit, only, partitions, shared_folder, short_shuffles

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Most tokens of a segment; a longer document is a segment of its own.
SEGMENT = 1 << 21
_BLOCK = 512  # bits that one entry of the directory covers
_PART = 1 << 15  # bytes of a plane that are compressed together, a multiple of the directory's blocks
_MAGIC = b"WVM2"
#: Runs of letters, digits or signs whose ids a worker keeps.
RUNS = 400_000
FILES = "shard int, segment int, start long, n_tokens long, n_docs long, data binary"


class _Parts:
    """A bit-plane compressed in parts, inflated as they are looked into."""

    def __init__(self, data: memoryview, ends: np.ndarray, size: int):
        self.data, self.ends, self.size = data, ends, size
        self.open: dict[int, np.ndarray] = {}

    def part(self, k: int) -> np.ndarray:
        if k not in self.open:
            raw = zstandard.decompress(self.data[self.ends[k] : self.ends[k + 1]])
            self.open[k] = np.frombuffer(raw, dtype=np.uint8)
        return self.open[k]

    def __getitem__(self, at: int | slice) -> np.ndarray | np.uint8:
        """A byte, or bytes that lie in one part."""
        if isinstance(at, slice):
            if at.start >= self.size:
                return np.zeros(0, dtype=np.uint8)
            k = at.start // _PART
            return self.part(k)[at.start - k * _PART : at.stop - k * _PART]
        return self.part(at // _PART)[at % _PART]

    def whole(self) -> np.ndarray:
        parts = [zstandard.decompress(self.data[a:b]) for a, b in zip(self.ends[:-1], self.ends[1:])]
        return np.frombuffer(b"".join(parts), dtype=np.uint8)


class WaveletMatrix:
    """Access, rank and select over a sequence of unsigned integers."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray] | list[_Parts], zeros: list[int], directory: list[np.ndarray]):
        self.n, self.bits, self.planes, self.zeros, self.directory = n, bits, planes, zeros, directory

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, directory = [], [], []
        kind = np.uint16 if bits <= 16 else np.uint32
        values = values.astype(kind)
        other = np.empty_like(values)
        for bit in range(bits - 1, -1, -1):
            ones = (values & kind(1 << bit)).astype(bool)
            plane = np.packbits(ones, bitorder="little")
            planes.append(plane)
            directory.append(cls._counts(plane))
            n_zeros = len(values) - int(directory[-1][-1])
            zeros.append(n_zeros)
            np.compress(~ones, values, out=other[:n_zeros])
            np.compress(ones, values, out=other[n_zeros:])
            values, other = other, values
        return cls(len(values), bits, planes, zeros, directory)

    @staticmethod
    def _counts(plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(plane) // (_BLOCK // 8)) * (_BLOCK // 8), dtype=np.uint8)
        padded[: len(plane)] = plane
        per = np.bitwise_count(padded.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1)
        return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)

    def to_bytes(self) -> bytes:
        parts = [zstandard.compress(p[a : a + _PART].tobytes(), 1) for p in self.planes for a in range(0, len(p), _PART)]
        head = struct.pack("<QI", self.n, self.bits) + np.array(self.zeros, dtype="<u8").tobytes()
        ends = np.cumsum([0, *map(len, parts)]).astype("<u8").tobytes()
        return head + b"".join(d.astype("<u4").tobytes() for d in self.directory) + ends + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: memoryview) -> WaveletMatrix:
        n, bits = struct.unpack_from("<QI", data)
        at = 12 + 8 * bits
        zeros = np.frombuffer(data, dtype="<u8", count=bits, offset=12).astype(int).tolist()
        size = (n + 7) // 8
        entries, parts = -(-size // (_BLOCK // 8)) + 1, -(-size // _PART)
        directory = [np.frombuffer(data, dtype="<u4", count=entries, offset=at + k * 4 * entries) for k in range(bits)]
        at += bits * 4 * entries
        ends = np.frombuffer(data, dtype="<u8", count=bits * parts + 1, offset=at).astype(np.int64)
        body = data[at + 8 * len(ends) :]
        planes = [_Parts(body, ends[k * parts : (k + 1) * parts + 1], size) for k in range(bits)]
        return cls(n, bits, planes, zeros, directory)

    def _ones(self, k: int, at: int) -> int:
        """Ones of plane k before place ``at``."""
        block = at // _BLOCK
        part = np.unpackbits(self.planes[k][block * _BLOCK // 8 : (at + 7) // 8], bitorder="little")
        return int(self.directory[k][block]) + int(part[: at - block * _BLOCK].sum())

    def _bit(self, k: int, at: int) -> int:
        return int(self.planes[k][at >> 3] >> (at & 7)) & 1

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, at), self._ones(k, at)
            value = value << 1 | bit
            at = self.zeros[k] + ones if bit else at - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``value`` at places lo <= place < hi."""
        if value < 0 or value >> self.bits:
            return 0
        lo, hi = self._range(value, lo, self.n if hi is None else hi)
        return hi - lo

    def rank(self, value: int, at: int) -> int:
        return self.count(value, 0, at)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence, from 0, or -1."""
        if k < 0 or k >= self.count(value):
            return -1
        at = self._range(value, 0, self.n)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - p) & 1
            at = self._place(p, bit, at - self.zeros[p] if bit else at)
        return at

    def _place(self, k: int, bit: int, nth: int) -> int:
        """The place of the nth (from 0) bit of this value in plane k."""
        ones = self.directory[k].astype(np.int64)
        before = ones if bit else np.arange(len(ones), dtype=np.int64) * _BLOCK - ones
        block = int(np.searchsorted(before[:-1], nth, side="right")) - 1
        part = np.unpackbits(self.planes[k][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(part == bit)[nth - int(before[block])])

    def values(self) -> np.ndarray:
        """The whole sequence."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for k in range(self.bits - 1, -1, -1):
            plane = self.planes[k]
            ones = np.unpackbits(plane.whole() if isinstance(plane, _Parts) else plane, count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, dtype=kind)
            back[~ones] = out[: self.zeros[k]]
            back[ones] = out[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            out = back
        return out


def pack(ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray, bits: int) -> bytes:
    """One segment: the documents' ids and lengths, then the matrix."""
    null = np.array([i is None for i in ids], dtype=np.uint8)
    head = null.tobytes() + np.array([i or 0 for i in ids], dtype="<i8").tobytes() + lengths.astype("<u8").tobytes()
    head = zstandard.compress(head, 1)
    return _MAGIC + struct.pack("<IQ", len(ids), len(head)) + head + WaveletMatrix.build(tokens, bits).to_bytes()


def unpack(data: bytes) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    """Document ids, lengths and the matrix of a segment."""
    if data[:4] != _MAGIC:
        raise ValueError("no segment of a token store")
    n, size = struct.unpack_from("<IQ", data, 4)
    head = zstandard.decompress(data[16 : 16 + size])
    null = np.frombuffer(head, dtype=np.uint8, count=n).astype(bool)
    ids = pa.array(np.frombuffer(head, dtype="<i8", count=n, offset=n), pa.int64(), mask=null)
    lengths = np.frombuffer(head, dtype="<u8", count=n, offset=9 * n).astype(np.int64)
    return ids, lengths, WaveletMatrix.from_bytes(memoryview(data)[16 + size :])


#: Pieces of letters, digits and signs whose class no version of Unicode changes.
_PLAIN = re.compile(r" ?[!-~À-ÖØ-öø-ɏ]+")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


def _byte_names() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[Pieces, int]:
    """Encodes pieces, and the number of ids.

    Most of the library's time for a short piece goes into its offsets. So plain pieces are split by the same pattern
    here and the library's model is asked for each run once; all others go through the library as they are.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    kind, code = ("<u2", "H") if size <= 1 << 16 else ("<u4", "I")
    model, names, runs = tokenizer.model, _byte_names(), pattern().findall
    known: dict[str, bytes] = {}

    def run(text: str) -> bytes:
        got = known.get(text)
        if got is None:
            got = array(code, [t.id for t in model.tokenize(text.encode().decode("latin-1").translate(names))]).tobytes()
            if len(known) < RUNS and len(text) <= 64:
                known[text] = got
        return got

    def ids(texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        for text in texts:
            if _LETTERS.fullmatch(text):
                out.append(run(text))
            elif _PLAIN.fullmatch(text):
                out.append(b"".join(map(run, runs(text))))
            else:
                out.append(None)
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(x.ids, dtype=kind).tobytes()
        return out

    return Pieces(ids, 600_000), size


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shards: int | None = None, most: int = SEGMENT) -> None:
    """Write the ids of all texts, each closed by id 0, in ascending order of the (integer) document id.

    most: tokens of a segment that holds more than one document.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(TOKENIZER)
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}, not an integer")
    docs = only(docs, id_col, text_col)
    shards = shards or partitions(spark)
    key = F.col(id_col).cast("long")
    shares = [k / shards for k in range(1, shards)]
    found = docs.agg(F.percentile_approx(key, shares or [0.5], max(10_000, 20 * shards))).first()[0] if shards > 1 else None
    splits = np.unique(np.array(found or [], dtype=np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _tokenizer(path)
        for batch in batches:
            lo = 0
            for tokens in pieces(batch.column("text"), bytes(_width(path))):
                ids = batch.column("id").slice(lo, len(tokens))
                shard = np.searchsorted(splits, pc.fill_null(ids, -(2**63)).to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, tokens], names=["shard", "id", "ids"])
                lo += len(tokens)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, bits = ("<u2" if _width(path) == 2 else "<u4"), max(1, (_tokenizer(path)[1] - 1).bit_length())
        held: list[tuple[int | None, bytes]] = []
        shard, segment, start, size = -1, 0, 0, 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(t) for _, t in held], dtype=np.int64) // np.dtype(kind).itemsize
            data = pack([i for i, _ in held], lengths, np.frombuffer(b"".join(t for _, t in held), dtype=kind), bits)
            row = [shard, segment, start, int(lengths.sum()), len(held), data]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["shard", "segment", "start", "n_tokens", "n_docs", "data"])

        for batch in batches:
            for s, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(t) // np.dtype(kind).itemsize
                if held and (s != shard or size + n > most):
                    yield flush()
                    segment, start = (segment + 1, start + size) if s == shard else (0, 0)
                    held, size = [], 0
                shard = s
                held.append((i, t))
                size += n
        if held:
            yield flush()

    coded = docs.select(key.alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, "shard int, id long, ids binary")
    in_order = coded.repartitionById(len(splits) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "ids")
    with short_shuffles(spark):
        in_order.mapInArrow(build, FILES).write.option("compression", "uncompressed").parquet(folder)


@lru_cache(maxsize=2)
def _width(path: str) -> int:
    return 2 if _tokenizer(path)[1] <= 1 << 16 else 4


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit) from the files.

    Only one total per shard goes to the driver.
    """
    files = _files(spark, folder)
    offsets, before = {}, 0
    for shard, n in sorted((r[0], r[1]) for r in files.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        offsets[shard], before = before, before + n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start = batch.column("shard")[row].as_py(), batch.column("start")[row].as_py()
                ids, lengths, matrix = unpack(batch.column("data")[row].as_py())
                tokens = pa.py_buffer(matrix.values().astype("<u4"))
                del matrix
                ends = np.concatenate([[0], np.cumsum(lengths)])
                for lo in range(0, len(ids), 4096):
                    part = ends[lo : lo + 4097]
                    n, base = len(part) - 1, int(part[0])
                    places = pa.py_buffer((4 * (part - base)).astype("<i4"))
                    own = pa.Array.from_buffers(pa.binary(), n, [None, places, tokens.slice(4 * base)])
                    yield pa.RecordBatch.from_arrays([ids[lo : lo + n], pa.array(part[:-1] + offsets[shard] + start, pa.int64()), pa.array(np.diff(part), pa.int64()), own], names=["doc_id", "start", "n_tokens", "ids"])

    return files.select("shard", "start", "data").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def count_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """shard, segment and the number of occurrences of one id, from the matrices alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [unpack(x.as_py())[2].count(token) for x in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("segment"), pa.array(n, pa.int64())], names=["shard", "segment", "n"])

    return _files(spark, folder).select("shard", "segment", "data").mapInArrow(count, "shard int, segment int, n long")


def tokens_at(spark: SparkSession, folder: str, shard: int, places: list[int]) -> dict[int, int]:
    """The ids at places of a shard, from 0. Only the segments that hold one of the places are read, and of those the bits on its way."""
    wanted = sorted(set(places))
    inside = F.exists(F.lit(wanted).cast("array<bigint>"), lambda p: (F.col("start") <= p) & (p < F.col("start") + F.col("n_tokens")))

    def access(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                matrix = unpack(data.as_py())[2]
                own = [p for p in wanted if start <= p < start + matrix.n]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([matrix.access(p - start) for p in own], pa.int64())], names=["place", "token"])

    files = _files(spark, folder).where((F.col("shard") == shard) & inside)
    return {r[0]: r[1] for r in files.select("start", "data").mapInArrow(access, "place long, token long").collect()}


def occurrence(spark: SparkSession, folder: str, shard: int, token: int, k: int) -> int:
    """The place in a shard of the k-th occurrence of an id, from 0, or -1: counts of its segments, then one segment's select."""
    before = 0
    for segment, n in sorted(count_token(spark, folder, token).where(F.col("shard") == shard).select("segment", "n").collect()):
        if 0 <= k - before < n:
            row = _files(spark, folder).where((F.col("shard") == shard) & (F.col("segment") == segment)).select("start", "data").first()
            return row["start"] + unpack(bytes(row["data"]))[2].select(token, k - before)
        before += n
    return -1


def digest(docs: DataFrame) -> DataFrame:
    """Write the store below the shared folder, read it back, and digest each document's ids."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder)
    gone_at_exit(spark, folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
