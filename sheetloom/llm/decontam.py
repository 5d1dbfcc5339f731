"""Benchmark decontamination by Aho-Corasick automata over the items' word windows.

Texts are normalised byte by byte (A-Z lower-cased, separators to spaces), so every place in the normalised
text is the same place in the original. Windows are looked for in one scan. The items are put into as few
automata as keep each one's windows under a fixed number of bytes; with the usual benchmark that is one. Of a larger
benchmark the driver holds one automaton's items at a time, every automaton takes a scan, and only hits are kept between.

Defined cases: null or wordless documents and items have no words and no hits; items with equal ids count once and
a null id is the empty string; repeated rows are scanned each; overlapping occurrences all count; very long texts are scanned
whole, and an item longer than an automaton holds has one of its own; an empty benchmark hits nothing; columns of any name
are kept, but those named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructType

from sheetloom.llm.shared import held, only, unused, written
from sheetloom.llm.words import LOWER

WINDOW = 13
#: Bytes of windows that one automaton may hold; it takes some 40 bytes of memory for each. What is broadcast is less.
AUTOMATON_BYTES = 6 << 20
#: A document is contaminated if one word in so many is hit.
SHARE = 20
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_NORMAL = bytes(32 if LOWER[b] in SEPARATORS else LOWER[b] for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _automaton(shared: Broadcast, size: int) -> ahocorasick.Automaton:
    """Built once in each worker; the value of a pattern is (its number of bytes, items)."""

    def make() -> ahocorasick.Automaton:
        found: dict[str, set[str]] = {}
        for item, text in shared.value:
            for window in windows(normal_words(text), size):
                found.setdefault(f" {b' '.join(window).decode('latin-1')} ", set()).add(item)
        automaton = ahocorasick.Automaton()
        for pattern, items in found.items():
            automaton.add_word(pattern, (len(pattern), sorted(items)))
        if found:
            automaton.make_automaton()
        return automaton

    return held(f"automaton {size}", shared.value, make)


def find(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged (start, end) byte spans of hit words in the original, items that occur."""
    words = text.translate(_NORMAL).split()
    if not words or not len(automaton):
        return len(words), [], set()
    joined = f" {b' '.join(words).decode('latin-1')} "
    items: set[str] = set()
    hits: list[tuple[int, int]] = []  # places in ``joined`` of the first and after the last byte of an occurrence's words
    for last, (n, who) in automaton.iter(joined):
        items.update(who)
        hits.append((last - n + 2, last))
    if not hits:
        return len(words), [], items
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths  # in ``joined``
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for a, b in hits:
        cover[np.searchsorted(starts, a)] += 1
        cover[np.searchsorted(starts, b)] -= 1
    hit = np.cumsum(cover)[:-1] > 0
    normal = np.frombuffer(text.translate(_NORMAL), dtype=np.uint8) != 32
    begin = np.flatnonzero(np.diff(np.concatenate([[False], normal]).astype(np.int8)) == 1)
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return len(words), list(zip(begin[first].tolist(), (begin[after - 1] + lengths[after - 1]).tolist())), items


def _spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte spans as spans of code points."""
    out, at, chars = [], 0, 0
    for a, b in spans:
        chars += len(text[at:a].decode())
        end = chars + len(text[a:b].decode())
        out.append({"start": chars, "end": end})
        at, chars = b, end
    return out


def _portions(items: Iterable[tuple[str, str]], size: int, most: int) -> Iterator[list[tuple[str, str]]]:
    """Items (id, text) in lists whose windows have at most ``most`` bytes, or of one item. At least one list."""
    held_: list[tuple[str, str]] = []
    n_held = 0
    for item, text in items:
        n = sum(len(w) + 1 for window in windows(normal_words(text), size) for w in window)
        if held_ and n_held + n > most:
            yield held_
            held_, n_held = [], 0
        held_.append((item, text))
        n_held += n
    yield held_


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "items array<string>, spans array<struct<start: int, end: int>>"


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, items (sorted), spans (of code points of the original text).

    A window is ``size`` consecutive words of an item, or all words of a shorter one. A word inside any occurrence
    of a window is hit. Words are runs of letters a-z, digits and non-ASCII characters.
    """
    items = only(benchmark, item_col, item_text_col).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    portions = _portions(((r[0], r[1]) for r in items.toLocalIterator()), size, most)
    first, second = next(portions), next(portions, None)
    if second is None:
        return _scanned(docs, text_col, first, size)
    place = unused(docs, "place")
    placed = written(docs.withColumn(place, F.monotonically_increasing_id()), "decontamination-docs")
    texts = placed.select(F.col(place).alias("place"), F.col(f"`{text_col}`").alias("text"))
    hits = [written(_hits(texts, portion, size), "decontamination-hits") for portion in chain([first, second], portions)]
    found = reduce(DataFrame.unionAll, hits).groupBy("place").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    name = unused(placed, "found")
    found = found.select(F.col("place").alias(place), F.struct("items", "spans").alias(name))
    return _scanned(placed.join(found, place, "left"), text_col, None, size, name).drop(place)


def _hits(texts: DataFrame, portion: list[tuple[str, str]], size: int) -> DataFrame:
    """place, items, byte spans of the texts in which any of these items occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(portion)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, size)
        for batch in batches:
            places, names, spans = [], [], []
            for place, text in zip(batch.column("place").to_pylist(), batch.column("text")):
                _, own, who = find((text.as_py() or "").encode(), automaton)
                if own:
                    places.append(place)
                    names.append(sorted(who))
                    spans.append([{"start": a, "end": b} for a, b in own])
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, _SPANS)], names=["place", "items", "spans"])

    return texts.mapInArrow(run, f"place long, {_FOUND}")


def _scanned(docs: DataFrame, text_col: str, portion: list[tuple[str, str]] | None, size: int, found: str | None = None) -> DataFrame:
    """The results of one scan by the items of ``portion``, or of what earlier ones left in the column ``found``."""
    results = ("n_words", "n_hit", "items", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(portion) if portion is not None else None
    own = [f for f in docs.schema if f.name.lower() not in results and f.name != found]
    schema = StructType([*own]).add("n_words", LongType()).add("n_hit", LongType()).add("items", ArrayType(StringType())).add("spans", DataType.fromDDL("array<struct<start: int, end: int>>"))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, size) if shared is not None else None
        for batch in batches:
            n_words, n_hit, spans, names = [], [], [], []
            before = batch.column(found).to_pylist() if found else repeat(None)
            for text, old in zip(batch.column(text_col), before):
                raw = (text.as_py() or "").encode()
                if automaton is None:
                    n, hit = len(raw.translate(_NORMAL).split()), _merged([(x["start"], x["end"]) for x in (old or {}).get("spans") or []])
                    who = set((old or {}).get("items") or [])
                else:
                    n, hit, who = find(raw, automaton)
                n_words.append(n)
                n_hit.append(sum(len(raw[a:b].translate(_NORMAL).split()) for a, b in hit))
                spans.append(_spans(raw, hit))
                names.append(sorted(who))
            columns = [batch.column(f.name) for f in own]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contaminated(scanned: DataFrame, share: int = SHARE) -> DataFrame:
    return scanned.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are contaminated, each judged by its own text."""
    if not {c.lower() for c in docs.columns} & {"n_words", "n_hit", "items", "spans", "contaminated"}:
        return contaminated(scan(docs, benchmark, text_col)).where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
    name = unused(docs, "row")  # its own columns of these names wait in a struct
    texts = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name), docs[f"`{text_col}`"].alias("text"))
    left = contaminated(scan(texts, benchmark)).where(~F.col("contaminated"))
    return left.select(*[F.col(f"{name}.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contaminated(scan(docs.select("doc_id", "text"), benchmark))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
