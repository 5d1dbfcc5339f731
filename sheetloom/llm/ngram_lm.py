"""Interpolated modified Kneser-Ney model of word n-grams.

Counting is rounds of questions from blocks of documents to hash-ranged buckets, from the longest n-grams to single
words. A bucket's part of the model is one sorted hash array with columns of counts. One block owns each trained
n-gram, as its bucket says, and adds it to the counts of its context and of its suffix in the next round, so that no
context, however frequent, comes together in one task. A bucket answers what its blocks ask in the round that counts,
and that is what the trained corpus is scored from.

``train`` stores the arrays as rows of a table below the shared folder. ``score_with`` scores any texts by them: the
workers take a bucket's stored arrays as they are, mapped onto the bytes that Spark read, and look keys up by binary
search. No worker maps a file of another machine, as the shared folder may be in a store that only Spark reads.
No part of the model goes to the driver but a few sums, and all of it grows with the corpus.

Defined cases: null or empty text is scored as its end alone; repeated rows count as often as they are there, and ties
of counts need no order; a null id counts as an empty text when rows are held out; very long texts are whole; without
any training text every token gets the uniform probability 1; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm import words as W
from sheetloom.llm.exchange import Buckets, ask, bucket_count, cut, figures, key_bits, packed, rows_of, small_batches, text_bytes, texts_of, told, unpack, with_answers
from sheetloom.llm.shared import only, written

#: Of the query; a smaller model is one of fewer words of context.
ORDER = 3
_BEGIN, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
SCHEMA = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

# columns that a block sends for an n-gram: its count; if it is not one of the longest, the sum of counts as a context and
# how many followers were seen once, twice, more often; for a single word its number of tokens


def _columns(m: int, order: int) -> int:
    return 1 + (m < order) * 4 + (m == 1 < order)


def held_out(doc_id: int | str | None, parts: int) -> bool:
    """crc32 of the id as text, modulo ``parts``, is 0; a null id counts as an empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts == 0


class _Block:
    """The n-grams of a block's texts: for each order the hash at every token and whether it is trained on."""

    def __init__(self, row: dict, id_col: str, text_col: str, parts: int, order: int):
        self.table = unpack(row["payload"])
        w = W.split(texts_of(self.table, text_col), lower=True)
        n = np.diff(w.first)
        self.lengths = n + 1  # with the end
        stops = np.cumsum(self.lengths)
        self.starts = stops - self.lengths
        self.tokens = np.empty(int(stops[-1]) if len(stops) else 0, dtype=np.uint64)
        word = np.ones(len(self.tokens), dtype=bool)
        word[stops - 1] = False
        self.tokens[word], self.tokens[stops - 1] = w.hashes, _END
        self.held = np.array([held_out(x, parts) for x in self.table.column(id_col).to_pylist()], dtype=bool)
        self.trained = np.repeat(~self.held, self.lengths)
        depth = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)
        self.grams, gram = {1: self.tokens}, self.tokens
        for k in range(1, order):
            before = np.full(len(self.tokens), _BEGIN, dtype=np.uint64)
            before[k:] = self.tokens[: len(self.tokens) - k] if k else self.tokens
            before[depth < k] = _BEGIN
            gram = W.mix(gram * np.uint64(0x9E3779B97F4A7C15) ^ W.mix(before + np.uint64(k)))
            self.grams[k + 1] = gram
        # the context of an n-gram is the (n-1)-gram that ends one token earlier
        self.contexts = {}
        for m in range(2, order + 1):
            shifted = np.empty_like(self.tokens)
            shifted[1:] = self.grams[m - 1][:-1]
            begin = _BEGIN
            for k in range(1, m - 1):
                begin = W.mix(np.array([begin * np.uint64(0x9E3779B97F4A7C15) ^ W.mix(np.array([_BEGIN + np.uint64(k)], dtype=np.uint64))[0]], dtype=np.uint64))[0]
            shifted[depth == 0] = begin
            self.contexts[m] = shifted

    def keys(self, m: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Distinct hashes asked about in round ``m``, and which is whose: m-grams, and contexts of longer ones."""
        grams = self.grams[m]
        if m == order:
            keys, index = np.unique(grams, return_inverse=True)
            return keys, index, None
        keys, index = np.unique(np.concatenate([grams, self.contexts[m + 1]]), return_inverse=True)
        return keys, index[: len(grams)], index[len(grams) :]


def _store(model: np.ndarray, table: list[np.ndarray]) -> bytes:
    """Keys and columns one after another, as they lie in memory."""
    head = struct.pack("<QQ", len(model), len(table))
    return head + model.astype("<u8").tobytes() + b"".join(x.astype("<i8").tobytes() for x in table)


def _mapped(data: bytes | None, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The arrays that ``_store`` gave, on the same bytes."""
    if data is None:
        return np.zeros(0, dtype="<u8"), [np.zeros(0, dtype="<i8")] * columns
    n, k = struct.unpack_from("<QQ", data)
    return np.frombuffer(data, "<u8", n, 16), [np.frombuffer(data, "<i8", n, 16 + 8 * n * (j + 1)) for j in range(k)]


def _resolve(order: int, keep: bool) -> Callable:
    def resolve(kind: int, keys: list[np.ndarray], values: list[list[np.ndarray]]) -> tuple:
        model, index = np.unique(np.concatenate(keys), return_inverse=True)
        has = np.concatenate([v[0] for v in values]) > 0
        owner = np.zeros(len(index), dtype=np.uint8)
        mine = np.flatnonzero(has)
        owner[mine[np.unique(index[mine], return_index=True)[1]]] = 1
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        answers = [[x] for x in np.split(owner, cuts)]
        table = []
        for j in range(_columns(kind, order)):  # one at a time: a column of answers is as long as all questions
            column = np.bincount(index, weights=np.concatenate([v[j] for v in values]), minlength=len(model)).astype(np.int64)
            small = column.astype(np.min_scalar_type(int(column.max())) if len(column) else np.uint8)
            for own, x in zip(answers, np.split(small[index], cuts)):
                own.append(x)
            table.append(column)
        count, raw = table[0], table[-1]
        stats = [int((count == k).sum()) for k in (1, 2, 3, 4)] + [int(count.sum()), int((count > 0).sum()), int(raw.sum()), int((raw > 0).sum())]
        if not keep:
            return answers, stats
        seen = np.flatnonzero(np.any([x > 0 for x in table], axis=0))
        return answers, stats, _store(model[seen], [x[seen] for x in table])

    return resolve


def _look_up(order: int) -> Callable:
    """Answers from a bucket's stored arrays."""

    def resolve(kind: int, keys: list[np.ndarray], values: list[list[np.ndarray]], stored: bytes | None) -> tuple:
        model, table = _mapped(stored, _columns(kind, order))
        answers = []
        for k in keys:
            at = np.minimum(np.searchsorted(model, k), max(len(model) - 1, 0))
            found = np.flatnonzero(model[at] == k) if len(model) else np.zeros(0, dtype=np.int64)
            own = [np.zeros(len(k), dtype=np.uint8)]
            for column in table:
                x = np.zeros(len(k), dtype=np.int64)
                x[found] = column[at[found]]
                own.append(x)
            answers.append(own)
        return answers, []

    return resolve


def _discounts(s: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from the numbers of n-grams counted 1 to 4 times.

    Where one of those numbers is 0, as in tiny corpora, half of the usual bound is taken.
    """
    n = s[:4].astype(float) if len(s) >= 4 else np.zeros(4)
    if (n > 0).all():
        y = n[0] / (n[0] + 2 * n[1])
        d = np.array([0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))])
        if (d[1:] > 0).all() and (d[1:] < (1, 2, 3)).all():
            return d
    return np.array([0, 0.5, 1.0, 1.5])


class Model(NamedTuple):
    """A trained model: its rows in the shared folder for each order, and what a few sums say."""

    stored: dict[int, DataFrame]
    sums: dict[int, np.ndarray]
    n_buckets: Buckets
    bits: dict[int, int]
    order: int


class _Rounds:
    """What counting and scoring share: blocks with cut keys, and the probability of each token from the answers."""

    def __init__(self, id_col: str, text_col: str, parts: int, order: int, n_buckets: Buckets, bits: dict[int, int]):
        self.id_col, self.text_col, self.parts, self.order, self.n_buckets, self.bits = id_col, text_col, parts, order, n_buckets, bits

    def block(self, row: dict) -> _Block:
        b = _Block(row, self.id_col, self.text_col, self.parts, self.order)
        b.grams = {m: cut(g, self.bits[m]) for m, g in b.grams.items()}
        b.contexts = {m: cut(c, self.bits[m - 1]) for m, c in b.contexts.items()}
        return b

    def told(self, row: dict, m: int, keys: np.ndarray, name: str | None = None) -> list[np.ndarray]:
        return told(row, name or f"a{m}", m, keys, self.n_buckets, 1 + _columns(m, self.order))

    def scored(self, sums: dict[int, np.ndarray], name: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        order, id_col = self.order, self.id_col
        discounts = {m: _discounts(s) for m, s in sums.items()}
        one = sums[1] if len(sums[1]) > 1 else np.zeros(8, dtype=np.int64)
        once, twice, total, types, tokens, seen = (int(one[k]) for k in (0, 1, 4, 5, 6, 7))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                b = self.block(row)
                keys, index, contexts = b.keys(1, order)
                got = self.told(row, 1, keys, name)
                raw, c, d = got[-1][index].astype(float), got[1][index].astype(float), discounts[1]
                if total:
                    spare = (d[1] * once + d[2] * twice + d[3] * (types - once - twice)) / total
                    p = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / total + spare / (seen + 1)
                else:
                    p = np.ones(len(index))
                for m in range(2, order + 1):
                    sums_, n1, n2, n3 = (x[contexts].astype(float) for x in got[2:6])
                    keys, index, contexts = b.keys(m, order)
                    got = self.told(row, m, keys, name)
                    c, d = got[1][index].astype(float), discounts[m]
                    known = sums_ > 0
                    safe = np.where(known, sums_, 1)
                    higher = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / safe + (d[1] * n1 + d[2] * n2 + d[3] * n3) / safe * p
                    p = np.where(known, higher, p)
                base = np.log10((raw + 0.1) / (tokens + 0.1 * (seen + 1)))
                add = lambda x: np.add.reduceat(x, b.starts) if len(b.starts) else x[:0]
                yield pa.RecordBatch.from_arrays(
                    [b.table.column(id_col).combine_chunks(), pa.array(b.held), pa.array(b.lengths, pa.int64()), pa.array(add((raw > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(b.starts), tokens), pa.int64()), pa.array(add(base), pa.float64()), pa.array(add(np.log10(p)), pa.float64())],
                    names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

        return run


def _counted(docs: DataFrame, id_col: str, text_col: str, order: int, parts: int, keep: bool) -> tuple[_Rounds, DataFrame, dict[str, DataFrame], dict[int, np.ndarray]]:
    """The rounds of counting: blocks, the answers to them and the sums of every order."""
    blocks = packed(only(docs, id_col, text_col), text_col, "lm-blocks")
    n_bytes = text_bytes(blocks)
    n_buckets = bucket_count(docs.sparkSession, n_bytes)
    bits = {m: key_bits(n_bytes, 20) if m > 1 else 64 for m in range(1, order + 1)}
    n_values = {m: _columns(m, order) for m in range(1, order + 1)}
    rounds, asked = _Rounds(id_col, text_col, parts, order, n_buckets, bits), {}

    def emit(m: int) -> Callable[[dict], list]:
        def run(row: dict) -> list:
            b = rounds.block(row)
            keys, grams, contexts = b.keys(m, order)
            if not len(keys):
                return []
            count = lambda at, weight: np.bincount(at, weights=weight, minlength=len(keys)).astype(np.uint64)
            if m == order:
                return [(m, keys, [count(grams, b.trained)])]
            longer, index, _ = b.keys(m + 1, order)
            got = rounds.told(row, m + 1, longer)
            # the first trained place of each longer n-gram that this block owns
            first = np.zeros(len(b.tokens), dtype=bool)
            trained = np.flatnonzero(b.trained)
            first[trained[np.unique(index[trained], return_index=True)[1]]] = True
            mine = first & (got[0][index] > 0)
            c = got[1][index].astype(float)
            sent = [count(grams, mine), count(contexts, mine * c), *(count(contexts, mine & hit) for hit in (c == 1, c == 2, c >= 3))]
            return [(m, keys, sent if m > 1 else [*sent, count(grams, b.trained)])]

        return run

    for m in range(order, 0, -1):
        asking = with_answers(blocks, **{f"a{m + 1}": asked[f"a{m + 1}"]}) if m < order else blocks
        asked[f"a{m}"] = ask(asking, emit(m), _resolve(order, keep), n_buckets, n_values, bits, f"lm-{m}")
    return rounds, blocks, asked, {m: figures(asked[f"a{m}"], m) for m in range(1, order + 1)}


def _result(blocks: DataFrame, answers: dict[str, DataFrame], run: Callable, docs: DataFrame, id_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    with small_batches(docs.sparkSession):
        return written(with_answers(blocks, **answers).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}"), "lm-scores")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, parts: int = 10) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Trained on the rows for which ``held_out(id, parts)`` is false. Tokens are lower-cased (A-Z) words without ASCII
    white space and one end. base_score is the add-0.1 unigram score, score the model's, both in log10.
    Perplexity is ``10 ** (-score / n_tokens)``. Keys have so many bits that one in a million may meet another's.
    """
    rounds, blocks, asked, sums = _counted(docs, id_col, text_col, order, parts, False)
    return _result(blocks, asked, rounds.scored(sums), docs, id_col)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, parts: int = 10) -> Model:
    """The model of the rows that ``held_out`` leaves, stored for ``score_with``."""
    rounds, _, asked, sums = _counted(docs, id_col, text_col, order, parts, True)
    return Model({m: asked[f"a{m}"] for m in range(1, order + 1)}, sums, rounds.n_buckets, rounds.bits, order)


def score_with(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10) -> DataFrame:
    """As ``score``, by a stored model, for texts that it may not have seen."""
    blocks = packed(only(docs, id_col, text_col), text_col, "lm-blocks")
    rounds = _Rounds(id_col, text_col, parts, model.order, model.n_buckets, model.bits)
    answers, order = {}, model.order
    for m in range(1, order + 1):

        def emit(row: dict, m: int = m) -> list:
            keys, *_ = rounds.block(row).keys(m, order)
            return [(m, keys, [])] if len(keys) else []

        answers[f"a{m}"] = ask(blocks, emit, _look_up(order), model.n_buckets, dict.fromkeys(model.bits, 0), model.bits, f"lm-asked-{m}", model.stored[m])
    return _result(blocks, answers, rounds.scored(model.sums), docs, id_col)


def perplexity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
