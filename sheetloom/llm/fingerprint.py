"""Canonical exact digest of documents, by DataFrame functions alone.

The canonical text is in Unicode normal form KC, with its case folded and normalised again, with every run of white
space as one space and none at the ends. The fingerprint is two xxHash64 values of it with different seeds, 128 bits
in hex. Documents of one fingerprint are a bucket. In every bucket of two or more the canonical texts themselves are
compared: the least and the greatest of them, byte by byte, are equal or the bucket is split, so a collision joins
nothing. Copies are reduced to one text in each task before they move, and texts without a copy do not move for it.

Defined cases: null text counts as empty; repeated rows are in one group; a null id is in its texts' group and names
none; a table of one document has itself as the next; null ids come before others, and ties of the id are ordered by
the hash of their text; very long texts are taken whole; ids that are no integers are refused; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sheetloom.llm.shared import meet, only, partitions, written

_SEEDS = (0x2545F491, 0x6C62272E)
#: Runs of neighbouring ids for each shuffle partition.
RUNS = 8
#: Buckets of several documents that are broadcast, of under 200 bytes each; more are joined by a shuffle.
BROADCAST = 200_000


def canonical(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    # the normaliser and the case folding that ship with Spark for its collations
    normal = lambda t: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    folded = normal(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal(whole), F.lit(True)))
    ascii_only = F.octet_length(whole) == F.char_length(whole)
    single = F.regexp_replace(F.when(ascii_only, F.lower(whole)).otherwise(folded), r"(?U)[\s&&[^ ]]\s*| \s+", " ")
    return F.trim(single)


def fingerprint(canonical_text: Column) -> Column:
    halves = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canonical_text))), 16, "0") for seed in _SEEDS]
    return F.concat(*halves)


def likeness(left: Column, right: Column, left_text: Column, right_text: Column) -> Column:
    """1.0 for equal fingerprints of texts whose canonical bytes are equal too, else 0.0."""
    return ((left == right) & (left_text.cast("binary") == right_text.cast("binary"))).cast("double")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint, group_id for every row: the smallest id among the documents of the same canonical text."""
    return _grouped(written(_marked(docs, id_col, text_col).drop("c"), "fingerprints"), docs, id_col, text_col).select(id_col, "fingerprint", "group_id")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, canonical text c, fingerprint and sha of c."""
    texts = only(docs, id_col, text_col).select(F.col(id_col), canonical(F.col(text_col)).alias("c"))
    return texts.select(id_col, "c", fingerprint(F.col("c")).alias("fingerprint"), F.sha2("c", 256).alias("sha"))


def _grouped(prints: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``prints`` (a written table with id, fingerprint, sha) with group_id instead of sha.

    Texts are compared in buckets of several documents alone; where two of a bucket differ, sha tells its groups apart.
    """
    buckets = prints.groupBy("fingerprint").agg(F.count("*").alias("m"), F.min(id_col).alias("group_id"))
    several = written(buckets.where("m > 1"), "buckets")
    known = several.select(F.col("fingerprint").alias("bucket"))
    known = F.broadcast(known) if several.count() <= BROADCAST else known.hint("shuffle_hash")
    inside = _marked(docs, id_col, text_col).join(known, F.col("fingerprint") == F.col("bucket"), "left_semi")
    compared = inside.groupBy("fingerprint").agg(F.min("c").alias("least"), F.max("c").alias("greatest"))
    odd = written(compared.where("least != greatest").select("fingerprint"), "collisions")
    if odd.isEmpty():
        return meet(prints, several, "fingerprint").withColumn("group_id", F.coalesce("group_id", id_col)).drop("sha", "m")
    # a collision of 128 bits: group by the whole digest as well
    key = F.concat("fingerprint", F.when(F.col("odd"), F.col("sha")).otherwise(F.lit("")))
    marked = prints.join(F.broadcast(odd.withColumn("odd", F.lit(True))) if odd.count() <= BROADCAST else odd.withColumn("odd", F.lit(True)), "fingerprint", "left")
    marked = written(marked.withColumn("_group", key).drop("odd"), "fingerprints")
    per = marked.groupBy("_group").agg(F.count("*").alias("m"), F.min(id_col).alias("group_id")).where("m > 1")
    return meet(marked, per, "_group").withColumn("group_id", F.coalesce("group_id", id_col)).drop("sha", "m", "_group")


def _place(splits: list[int], key: Column) -> Column:
    """How many of the sorted splits are at most ``key``, by a look at every 64th and then within."""
    if not splits:
        return F.lit(0)
    all_, coarse = F.lit(splits), F.lit(splits[::64])
    block = F.size(F.filter(coarse, lambda s: s <= key))
    near = F.slice(all_, (F.greatest(block, F.lit(1)) - 1) * 64 + 1, 64)
    return F.when(block == 0, 0).otherwise((block - 1) * 64 + F.size(F.filter(near, lambda s: s <= key)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "next_text") -> DataFrame:
    """id, text and the text of the next document in ascending order of the (integer) id; the first follows the last.

    Documents go to runs between quantiles of the id, a few for each shuffle partition. The first document of a run stands
    at the end of the run before it as well, so no window is over the whole table.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}, not an integer")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    base = only(docs, id_col, text_col).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col), key.alias("_key"))
    n, least = base.agg(F.count("*"), F.min("_key")).first()
    runs = min(max(n, 1), RUNS * partitions(docs.sparkSession))
    found = base.agg(F.percentile_approx("_key", [k / runs for k in range(1, runs)] or [0.5], max(10_000, 20 * runs))).first()[0] if n else []
    splits = sorted({s for s in found or [] if s > least})
    placed = base.withColumn("_run", _place(splits, F.col("_key")))
    if splits:
        begins = F.when(F.col("_run") > 0, F.get(F.lit(splits), F.col("_run") - 1) == F.col("_key")).otherwise(F.col("_key") == F.lit(least))
        before = F.when(F.col("_run") > 0, F.col("_run") - 1).otherwise(len(splits))
    else:
        begins, before = F.col("_key") == F.lit(least), F.lit(0)
    own, guest = F.struct(F.col("_run").alias("run"), F.lit(False).alias("guest")), F.struct(before.alias("run"), F.lit(True).alias("guest"))
    both = placed.withColumn("_at", F.explode(F.when(begins, F.array(own, guest)).otherwise(F.array(own))))
    in_order = Window.partitionBy("_at.run").orderBy("_at.guest", "_key", F.xxhash64(text_col))
    return both.withColumn(out, F.lead(text_col).over(in_order)).where(~F.col("_at.guest")).select(id_col, text_col, out)


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, the group of each among all, and fingerprints of texts whose second half is taken from the next document."""
    pairs = with_next(docs.select("doc_id", "text")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    texts = pairs.withColumn("edited", edited).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("e"), canonical(F.col("next_text")).alias("x"))
    prints = texts.select("*", fingerprint(F.col("c")).alias("fingerprint"), F.sha2("c", 256).alias("sha"), fingerprint(F.col("e")).alias("edited_fingerprint"), fingerprint(F.col("x")).alias("_next"))
    like = lambda mark, text: likeness(F.col("fingerprint"), F.col(mark), F.col("c"), F.col(text))
    found = prints.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "sha", "edited_fingerprint", like("edited_fingerprint", "e").alias("near_edited"), like("_next", "x").alias("near_next"))
    return _grouped(written(found, "fingerprints"), docs, "doc_id", "text")
