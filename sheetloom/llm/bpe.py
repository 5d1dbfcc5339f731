"""Byte-level BPE encoding and raw-byte decoding by a local rank file.

Texts are first cut at safe boundaries: before an ASCII space that follows a character that is no white space.
No match of the splitting pattern goes over such a boundary and none looks behind, so the pieces encode
apart exactly as they do together. That keeps long texts linear, and a worker keeps the ids of pieces
that it has seen. A longer stretch without such a boundary is cut between matches of the pattern.

Defined cases: null or empty text has no ids; special tokens are ordinary text; repeated rows encode alike; very long texts
are encoded whole; an empty table stays empty; further columns are kept, and one that has the name of a result is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.shared import give_back, held, unused

RANKS = "byte_bpe_multi_50k.tiktoken"
#: White space before a space, in RE2 and for ``regex``: every class of it, and the separators that only some count.
_UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_SAFE = regex.compile(r"(?<![\s\x0b\x1c-\x1f]) ")
#: Pieces whose ids a worker keeps: about 30 MB.
KNOWN = 200_000
#: Bytes of text that are encoded at once; what is made of them takes some ten times as much.
CHUNK = 4 << 20
#: Characters of a stretch without safe boundary that are encoded at once.
STRETCH = 1 << 16


class Pieces:
    """Encodes texts piece by piece. ``encode`` maps strings to their ids as bytes; the ids of pieces of up to
    64 characters are kept, of ``limit`` pieces at most: those met last."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = KNOWN):
        self.encode, self.limit = encode, limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Of distinct pieces."""
        found = list(map(self.known.get, pieces))
        new = []
        for k, x in enumerate(found):
            if x is None:
                found[k] = x = self.older.get(pieces[k])
                if x is None:
                    new.append(k)
                else:
                    self.known[pieces[k]] = x
        for k, x in zip(new, self.encode([pieces[k] for k in new])):
            found[k] = x
            if len(pieces[k]) <= 64:
                self.known[pieces[k]] = x
        if len(self.known) > self.limit // 2:
            self.older, self.known = self.known, {}
        return found

    def __call__(self, texts: pa.Array, end: bytes = b"") -> Iterator[pa.Array]:
        """Binary arrays with the ids of the texts in order, each text closed by ``end``."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
            yield self._chunk(pc.fill_null(texts.slice(lo, hi - lo), ""), end)
            lo = hi

    def _chunk(self, texts: pa.Array, end: bytes) -> pa.Array:
        n = len(texts)
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        pieces = pc.split_pattern(texts, " ")
        if unsafe.any():
            cut = pa.array([_SAFE.split(t) for t in texts.filter(pa.array(unsafe)).to_pylist()], pieces.type)
            order = np.arange(n)
            order[unsafe] = n + np.arange(int(unsafe.sum()))
            pieces = pa.concat_arrays([pieces, cut]).take(pa.array(order))
        coded = pieces.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        first = pieces.offsets.to_numpy().astype(np.int64)
        first = first - first[0]
        # the first piece of a text has no space before it
        heads = coded.dictionary.take(coded.indices.take(pa.array(first[:-1]))).to_pylist()
        tail = np.ones(len(at), dtype=bool)
        tail[first[:-1]] = False
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[at[tail]] = True
        own = np.cumsum(used) - 1
        tails = [" " + x for x in coded.dictionary.filter(pa.array(used)).to_pylist()]
        at = own[at]
        ids = self.ids(tails)
        at[first[:-1]] = len(ids) + np.arange(n)
        distinct = dict.fromkeys(heads)
        distinct = dict(zip(distinct, self.ids(list(distinct))))
        if end:
            at = np.insert(at, first[1:], len(ids) + n)
            first = first + np.arange(n + 1)
        taken = pa.array([*ids, *map(distinct.__getitem__, heads), end], pa.binary()).take(pa.array(at))
        places = np.frombuffer(taken.buffers()[1], dtype=np.int32)[: len(at) + 1][first]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places), taken.buffers()[2]])


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``most`` characters that end where a match of the pattern ends."""
    if len(text) <= most:
        yield text
        return
    lo = 0
    for match in pattern().finditer(text):
        if match.end() - lo >= most:
            yield text[lo : match.end()]
            lo = match.end()
    if lo < len(text):
        yield text[lo:]


def _pieces(path: str) -> Pieces:
    encode = _encoding(path).encode_ordinary

    def ids(texts: list[str]) -> list[bytes]:
        return [np.array([i for part in stretches(t) for i in encode(part)] if len(t) > STRETCH else encode(t), dtype="<u4").tobytes() for t in texts]

    return held(f"pieces {path}", None, lambda: Pieces(ids))


def rank_file(path: str | None) -> str:
    return path or public_tokenizers.path(RANKS)


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the ids as little-endian unsigned 32-bit integers in the binary column ``out``.

    path: the rank file, on every machine; by default the one installed with the public tokenizers.
    """
    path = rank_file(path)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.binary()), *_pieces(path)(texts)])

    return _with(df, **{out: ids(df[f"`{text_col}`"])})


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the bytes that the ids stand for, not read as any character set, in the binary column ``out``."""
    path = rank_file(path)

    @F.arrow_udf("binary")
    def raw(ids: pa.Array) -> pa.Array:
        return _bytes(path, ids)

    return _with(df, **{out: raw(df[f"`{ids_col}`"])})


def _bytes(path: str, ids: pa.Array) -> pa.Array:
    back = _encoding(path).decode_bytes
    return pa.array([back(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in ids.to_pylist()], pa.binary())


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns last, in place of its own of the same names."""
    kept = [df[f"`{c}`"] for c in df.columns if c not in columns]
    return df.select(*kept, *[c.alias(name) for name, c in columns.items()])


def round_trip(df: DataFrame, text_col: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the columns that ``encode`` and then ``decode`` give, by one worker that takes ``CHUNK`` bytes at a time.

    Ids of one step after the other would hold two workers' tables and the batches between them in each executor core.
    """
    path = rank_file(path)

    @F.arrow_udf("ids binary, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        coded, raw = [pa.array([], pa.binary())], [pa.array([], pa.binary())]
        for found in _pieces(path)(texts):
            coded.append(found)
            raw.append(_bytes(path, found))
        coded, raw = pa.concat_arrays(coded), pa.concat_arrays(raw)
        give_back()
        return pa.StructArray.from_arrays([coded, raw], names=["ids", "decoded"])

    name = unused(df, "coded")
    coded = df.select("*", both(df[f"`{text_col}`"]).alias(name))
    return _with(coded, **{ids: F.col(f"{name}.ids"), decoded: F.col(f"{name}.decoded")}).drop(name)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes decoded from them."""
    coded = round_trip(docs.select("doc_id", "text"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
