"""Sharding by histogram sort, with equal bytes for each shard.

The sort key is (hash of the text, id), so equal texts lie side by side and go to one shard unless a shard
border must fall among them. Borders are found by probing: each round counts exactly the bytes below
every candidate key over all partitions, and narrows the interval of each border, until its weight
meets the tolerance. Then the rows are exchanged once, to the shards' finer slices, and numbered there.

Defined cases: null text has size 16; a null id comes first; rows of equal text and id are ties that stay together, in any order
among themselves; very long texts are whole and a shard that holds one may be larger by it; an empty table gives no rows;
ids that are no integers are refused; further columns are kept whatever their names, but size, shard and slot are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import IntegralType

from sheetloom.llm.shared import only, partitions, unused, written

SHARDS = 40
OVERHEAD = 16
#: A border may be off by this share of a shard's bytes.
TOLERANCE = 0.002
PROBES = 15
_TOP = 1 << 128


def _key(hashed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(hash, id) as 16 bytes whose order is that of the pair."""
    both = np.stack([hashed.astype(np.int64), ids.astype(np.int64)], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").reshape(-1)


def _keys(numbers: list[int]) -> np.ndarray:
    return np.array([n.to_bytes(16, "big") for n in numbers], dtype="S16")


def _histogram(keyed: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """For each interval between the sorted probes that has rows: exact bytes and rows, smallest and largest key."""
    edges = _keys(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _key(batch.column("hashed").to_numpy(), batch.column("id").to_numpy())
            order = np.argsort(key)
            key, size = key[order], batch.column("size").to_numpy()[order]
            at = np.searchsorted(edges, key, side="right")
            some, first, n = np.unique(at, return_index=True, return_counts=True)
            if len(some):
                low, high = ([x.ljust(16, b"\0") for x in key[k].tolist()] for k in (first, first + n - 1))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.add.reduceat(size, first)), pa.array(n, pa.int64()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], names=["at", "size", "n", "low", "high"])

    found = keyed.mapInArrow(count, "at long, size long, n long, low binary, high binary").groupBy("at").agg(F.sum("size"), F.sum("n"), F.min("low"), F.max("high"))
    return {r[0]: (r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in found.collect()}


def borders(keyed: DataFrame, total: int, slices: int, tolerance: float = TOLERANCE) -> list[int]:
    """Keys at which the next of ``slices`` begins, so that the bytes below are near their share.

    Each round brings one small row per probed interval to the driver, whatever the number of documents. An interval
    shrinks to the keys that it holds, so a group that fills one is cut by id at once.
    """
    goals = [total * k / slices for k in range(1, slices)]
    # for each goal: key and bytes below of the nearest known cut under and over it
    low, high = [(0, 0)] * len(goals), [(_TOP, total)] * len(goals)
    allowed = tolerance * total / slices
    while True:
        probes = set()
        for goal, (a, x), (b, y) in zip(goals, low, high):
            if b - a > 1 and min(goal - x, y - goal) > allowed:
                guess = a + (b - a) * int((goal - x) / max(y - x, 1) * (1 << 53)) // (1 << 53)
                width = max(1, (b - a) // 256)
                probes |= {a + (b - a) * k // (PROBES + 1) for k in range(1, PROBES + 1)} | {p for p in (guess + width * k // 4 for k in range(-4, 5)) if a < p < b}
                probes.discard(a)
        if not probes:
            break
        edges = sorted(probes)
        found = _histogram(keyed, edges)
        sums = list(accumulate(found.get(i, (0,))[0] for i in range(len(edges) + 1)))
        for k, goal in enumerate(goals):
            at = bisect_left(sums, goal)  # the interval in which the sum reaches the goal
            _, _, first, last = found[at]
            below = sums[at - 1] if at else 0
            low[k] = max(low[k], (first, below))
            high[k] = min(high[k], (last + 1, sums[at]))
    return [a if goal - x <= y - goal else b for goal, (a, x), (b, y) in zip(goals, low, high)]


def _slice(cuts: list[int], hashed: Column, id_: Column) -> Column:
    edges = _keys(cuts)

    @F.pandas_udf("int")
    def at(hashed, ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(edges, _key(hashed.to_numpy(), ids.to_numpy()), side="right").astype(np.int32))

    return at(hashed, id_)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """All columns of ``docs`` and size, shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    The size of a row is its text's UTF-8 bytes and 16; shards hold near equal bytes. Rows come out
    partitioned by slices of shards. Input columns of the names size, shard and slot are replaced.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}, not an integer")
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + OVERHEAD).cast("long")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    keyed = written(only(docs, id_col, text_col).select(hashed.alias("hashed"), key.alias("id"), size.alias("size")), "shard-keys")
    total, n = keyed.agg(F.sum("size"), F.count("*")).first()
    fine = max(1, -(-4 * partitions(docs.sparkSession) // shards))
    cuts = sorted(borders(keyed, total, shards * fine)) if n else []
    edges = sorted(set(cuts))
    found = _histogram(keyed, edges) if n else {}
    # slice -> its shard and the rows of the same shard before it
    shard_of = [0, *(bisect_right(cuts, e) // fine for e in edges)]
    first, ahead = [], dict.fromkeys(range(shards), 0)
    for s, k in enumerate(shard_of):
        first.append(ahead[k])
        ahead[k] += found[s][1] if s in found else 0
    own = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    h, i, s = (unused(docs, name) for name in ("hashed", "id", "slice"))
    sliced = docs.select(*[docs[f"`{c}`"] for c in own], size.alias("size"), hashed.alias(h), key.alias(i)).withColumn(s, _slice(edges, F.col(h), F.col(i)))
    in_slice = Window.partitionBy(s).orderBy(h, i)
    slot = F.get(F.lit(first), F.col(s)).cast("long") + F.row_number().over(in_slice) - 1
    return sliced.select(*[sliced[f"`{c}`"] for c in own], "size", F.get(F.lit(shard_of), F.col(s)).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One folder per shard, in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def digest(docs: DataFrame) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    placed = shard(docs.select("doc_id", "text"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
