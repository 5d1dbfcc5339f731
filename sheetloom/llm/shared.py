"""Helpers of the corpus operators: shared folder, written tables, column hygiene, memory of workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and runs on this machine alone (tests, a laptop) is a temporary one made and set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sheetloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def gone_at_exit(spark: SparkSession, folder: str) -> None:
    """The folder is deleted when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with these settings (dots as double underscores), and as it was before afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def short_shuffles(spark: SparkSession) -> AbstractContextManager:
    """What is written inside leaves no shuffle files behind."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and return it as read back.

    This cuts lineage and survives lost executors; what was shuffled for it is deleted at once, as nothing needs it any
    more. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with short_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, looked up exactly, so that further columns cannot clash."""
    return df.select(*[df[f"`{c}`"] for c in columns])


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that ``df`` does not have, by the resolver's blindness to case."""
    have = {c.lower() for c in df.columns}
    while f"_{name}".lower() in have:
        name += "_"
    return f"_{name}"


#: Keys that ``meet`` broadcasts at most.
HOT = 4096
#: Keys of a table that ``meet`` broadcasts whole, of under 200 bytes each.
FEW = 50_000


def meet(rows: DataFrame, per_key: DataFrame, key: str, m: str = "m", inner: bool = False) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one small row for a key and ``m``, how many of ``rows`` have it.

    A table of at most ``FEW`` keys is broadcast as it is. Of a larger one, a key that more than the 4096th part of the
    rows have is hot; there are fewer than 4096 of those, so they are broadcast and their rows stay where they are. No
    task of the shuffled rest gets a larger share for one key.
    Without ``inner``, rows without a partner or a key stay, with nulls. ``rows`` and ``per_key`` should be written
    tables, as they are read more than once.
    """
    total, keys = per_key.agg(F.sum(m), F.count("*")).first()
    if keys <= FEW:
        return rows.join(F.broadcast(per_key), key, "inner" if inner else "left")
    least = (total or 0) // HOT
    hot = F.broadcast(per_key.where(F.col(m) > least))
    cold = per_key.where(F.col(m) <= least)
    keyed = rows.where(F.col(key).isNotNull())
    met = keyed.join(hot, key).unionByName(keyed.join(hot, key, "left_anti").join(cold, key, "inner" if inner else "left"))
    return met if inner else met.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


_held: tuple[str, Any, Any] | None = None


def held(name: str, of: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives for ``name`` and the object ``of``. A worker keeps one such thing until it needs another.

    Spark reuses workers for the stages of all operators, whose tables would add up otherwise.
    """
    global _held
    if _held is None or _held[0] != name or _held[1] is not of:
        _held = None
        give_back()
        _held = (name, of, make())
    return _held[2]


def give_back() -> None:
    """Return the worker's free memory to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, for functions that keep nothing: what is held goes before, free memory after."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("", None, lambda: None)
        yield from run(batches)
        give_back()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
