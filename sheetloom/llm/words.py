"""Vectorised word splitting and sequence hashing over a batch of texts.

A word is a run of bytes outside a separator set. Hashes are 64-bit: each byte goes through a
fixed random table, a word is a polynomial over its bytes and a sequence a polynomial over its
mixed words, all from prefix sums, so any window costs the same whatever its length.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import xxhash

SPACES = b" \t\n\r\x0b\x0c"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 18
_LONG = 512  # words of more bytes are hashed one by one

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache
def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


@lru_cache
def _spaces(separators: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = True
    return table


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n).bit_length())
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=_U)
    return have[: n + 1]


_BYTE = 0x9E6C63D0876A9A63 | 1
_WORD = (0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)


@lru_cache
def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Words(NamedTuple):
    hashes: np.ndarray
    start: np.ndarray  # byte offsets in the joined texts
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words at the end
    offset: np.ndarray  # byte offset of each text


def split(texts: list[bytes], lower: bool = False, separators: bytes = SPACES, hashed: bool = True) -> Words:
    """The words of all texts, which are joined by one separator byte each."""
    gap = separators[:1]
    joined = gap.join(texts) + gap
    if lower:
        joined = joined.translate(LOWER)
    data = np.frombuffer(joined, dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offset = np.concatenate([[0], np.cumsum(lengths + 1)])
    space = _spaces(separators)[data]
    before = np.concatenate([[True], space[:-1]])
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(space & ~before)
    first = np.searchsorted(start, offset)
    hashes = _hash(joined, data, start, end) if hashed else np.zeros(0, dtype=_U)
    return Words(hashes, start, end, first, offset[:-1])


def _hash(joined: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), dtype=_U)
    lo = 0
    while lo < len(start):
        base = start[lo]
        hi = max(lo + 1, int(np.searchsorted(end, base + _CHUNK, side="right")))
        top = end[hi - 1]
        if hi == lo + 1 and top - base > _CHUNK:  # one very long word
            out[lo] = xxhash.xxh3_64_intdigest(joined[base:top])
        else:
            n = int(top - base)
            sums = np.zeros(n + 1, dtype=_U)
            np.cumsum(_table()[data[base:top]] * powers(_BYTE, n)[:n], out=sums[1:])
            s, e = start[lo:hi] - base, end[lo:hi] - base
            value = (sums[e] - sums[s]) * powers(_inverse(_BYTE), n)[s]
            out[lo:hi] = mix(value ^ ((e - s).astype(_U) * _U(0x9E3779B97F4A7C15)))
            for k in np.flatnonzero(e - s > _LONG):
                out[lo + k] = xxhash.xxh3_64_intdigest(joined[start[lo + k] : end[lo + k]])
        lo = hi
    return out


def windows(hashes: np.ndarray, size: int, at: np.ndarray | None = None, kind: int = 0) -> np.ndarray:
    """Hashes of the windows of ``size`` words that start at every place, or at the places given.

    The caller leaves out windows that would pass the end of a text; the last ``size - 1`` places have none.
    Places ascend. A value depends on the window's words alone, so stretches of places are hashed one after another.
    """
    n = len(hashes)
    at = np.arange(n - size + 1) if at is None else at
    if n < size or not len(at):
        return np.zeros(0, dtype=_U)
    base, out = _WORD[kind], np.empty(len(at), dtype=_U)
    edges = range(0, n - size + 1, _CHUNK)
    cuts = np.searchsorted(at, [*edges, n]).tolist()
    for lo, a, b in zip(edges, cuts, cuts[1:]):
        part = hashes[lo : lo + _CHUNK + size]
        m = len(part)
        sums = np.zeros(m + 1, dtype=_U)
        np.cumsum(part * powers(base, m)[:m], out=sums[1:])
        s = at[a:b] - lo
        out[a:b] = mix((sums[s + size] - sums[s]) * powers(_inverse(base), m)[s] + _U(size))
    return out
