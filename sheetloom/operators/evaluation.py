"""Evaluation against ground truth."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from operator import eq, ne
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sheetloom.functions.text import ENGINEERING_TERMS, bound, first_best, strip, words


def _masks(items: Sequence) -> dict[Any, int]:
    """For each item the places that hold it, as bits."""
    places: dict[Any, bytearray] = {}
    for k, x in enumerate(items):
        if x not in places:
            places[x] = bytearray(len(items) // 8 + 1)
        places[x][k >> 3] |= 1 << (k & 7)
    return {x: int.from_bytes(bits, "little") for x, bits in places.items()}


_LOOK, _AHEAD = 16, 20  # places that are compared to see whether, and how, an alignment goes on
_SHIFTS = np.array([1, 2, 3, 4, -1, -2, -3, -4])


def _numbered(p: Sequence, r: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers that are equal where the items are, each with an end that nothing equals."""
    if isinstance(p, str) and isinstance(r, str):
        both = [np.frombuffer(x.encode("utf-32-le"), dtype=np.int32) for x in (p, r)]
    else:
        names: dict[Any, int] = {}
        both = [np.array([names.setdefault(x, len(names)) for x in own], dtype=np.int32) for own in (p, r)]
    return tuple(np.concatenate([x, np.full(4 * _LOOK, end, dtype=np.int32)]) for x, end in zip(both, (-1, -2)))


def _some_alignment(p: Sequence, r: Sequence, most: int) -> int:
    """The edits of one alignment, found in one walk: replaced while most places agree, then moved on by what makes the next ones
    agree. It stops beyond ``most``."""
    a, b = _numbered(p, r)
    i, j, found, n_p, n_r = 0, 0, 0, len(p), len(r)
    run = _LOOK + _AHEAD
    place, step = np.arange(run), np.maximum(_SHIFTS, 0)[:, None]
    back = np.maximum(-_SHIFTS, 0)[:, None]
    while i < n_p and j < n_r and found <= most:
        n = min(4096, n_p - i, n_r - j)
        before = np.concatenate([[0], np.cumsum(a[i : i + n + _LOOK] != b[j : j + n + _LOOK])])  # beyond an end all differ
        apart = np.flatnonzero(before[_LOOK:] - before[:-_LOOK] > _LOOK // 2)
        k = min(int(apart[0]), n) if len(apart) else n
        found, i, j = found + int(before[k]), i + k, j + k
        if not len(apart) or i >= n_p or j >= n_r:
            continue
        stay = np.concatenate([[0], np.cumsum(a[i : i + run] != b[j : j + run])])
        moved = np.concatenate([np.zeros((len(_SHIFTS), 1), int), np.cumsum(a[i + step + place] != b[j + back + place], axis=1)], axis=1)
        # stay until t, then go on shifted
        left = (n_p - i) - (n_r - j)  # a shift that evens out the lengths costs nothing that is not due anyway
        price = np.abs(_SHIFTS) + np.abs(left - _SHIFTS) - abs(left)
        cost = stay[None, : _LOOK + 1] + price[:, None] + moved[:, -1:] - moved[:, : _LOOK + 1]
        s, t = divmod(int(cost.argmin()), _LOOK + 1)
        go = int(_SHIFTS[s]) if cost[s, t] < stay[-1] else 0
        t = min(t if go else _LOOK, n_p - i - max(go, 0), n_r - j - max(-go, 0))
        if t < 0:
            break
        found += int(stay[t]) + abs(go)
        i, j = i + t + max(go, 0), j + t + max(-go, 0)
    return found + abs((n_p - i) - (n_r - j)) if found <= most else found


def _edits(p: Sequence, r: Sequence) -> int:
    """Edit distance. Items without a partner at any place are a lower bound, an alignment found in one walk an upper one;
    where these two are not equal, all places are aligned, a row of the table as bits of one integer."""
    least = max(len(p), len(r)) - (Counter(p) & Counter(r)).total()
    if not p or not r or (len(p) == len(r) and sum(map(ne, p, r)) == least) or _some_alignment(p, r, least) == least:
        return least
    masks, last, full = _masks(r), len(r) - 1, (1 << len(r)) - 1
    up, down, found = full, 0, len(r)
    for x in p:
        same = masks.get(x, 0)
        zero = (((same & up) + up) ^ up) | same | down
        more, less = (down | ~(zero | up)) & full, zero & up
        found += (more >> last & 1) - (less >> last & 1)
        more = more << 1 | 1
        up, down = (less << 1 | ~(zero | more)) & full, zero & more & full
    return found


def _in_order(p: Sequence, r: Sequence) -> int:
    """Length of the longest common subsequence, with bounds and bits as in ``_edits``."""
    most = (Counter(p) & Counter(r)).total()
    if sum(map(eq, p, r)) == most:
        return most
    masks, full = _masks(r), (1 << len(r)) - 1
    row = full
    for x in p:
        hit = row & masks.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(r) - row.bit_count()


def _hits(p: list[str], r: list[str], n: int) -> int:
    """n-grams in common, each as often as both have it."""
    grams = lambda ws: Counter(zip(*(ws[k:] for k in range(n))))
    return (grams(p) & grams(r)).total()


def _rate(errors: int, of: int) -> float:
    """Errors in percent of the reference; without one, 0 if nothing was predicted either, else 100."""
    return errors / of * 100 if of else 100.0 * (errors > 0)


def _words(text: str | None) -> list[str]:
    return (text or "").split()  # white space as in functions.text.words


@F.pandas_udf(DoubleType())
def cer(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    """Character error rate in percent; null counts as empty."""
    return pd.Series([_rate(_edits(p or "", r or ""), len(r or "")) for p, r in zip(predicted, reference)], dtype=float)


@F.pandas_udf(DoubleType())
def word_error_rate(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    both = ((_words(p), _words(r)) for p, r in zip(predicted, reference))
    return pd.Series([_rate(_edits(p, r), len(r)) for p, r in both], dtype=float)


def wer(pairs: DataFrame, predicted: str = "predicted", reference: str = "reference", out: str = "wer") -> DataFrame:
    """Word error rate in percent; null counts as empty."""
    return pairs.withColumn(out, word_error_rate(predicted, reference))


@F.pandas_udf(DoubleType())
def unigram_recall(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    both = ((_words(p), _words(r)) for p, r in zip(predicted, reference))
    return pd.Series([_hits(p, r, 1) / len(r) if r else 0.0 for p, r in both], dtype=float)


def rouge1(pairs: DataFrame, key: str, predicted: str = "predicted", reference: str = "reference") -> DataFrame:
    """A row for every pair; 0 without words in the reference."""
    return pairs.select(key, unigram_recall(predicted, reference).alias("rouge1"))


def bleu(pairs: DataFrame, key: str, n: int = 4, predicted: str = "predicted", reference: str = "reference") -> DataFrame:
    """Geometric mean of 1- to n-gram precision with brevity penalty; 0 if any precision is. A row for every pair."""

    @F.pandas_udf(DoubleType())
    def precision(predicted: pd.Series, reference: pd.Series) -> pd.Series:
        out = []
        for p, r in zip(map(_words, predicted), map(_words, reference)):
            shares = [_hits(p, r, k) / (len(p) - k + 1) if len(p) >= k else 0.0 for k in range(1, n + 1)]
            out.append(math.exp(sum(map(math.log, shares)) / n + min(0.0, 1 - len(r) / len(p))) if min(shares) > 0 else 0.0)
        return pd.Series(out, dtype=float)

    return pairs.select(key, precision(predicted, reference).alias("bleu"))


@F.pandas_udf(DoubleType())
def rouge_l(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of words."""
    both = ((_words(p), _words(r)) for p, r in zip(predicted, reference))
    return pd.Series([2 * _in_order(p, r) / (len(p) + len(r)) if p or r else 0.0 for p, r in both], dtype=float)


def _points(text: str | None) -> np.ndarray:
    return np.array([ord(c) for c in text or ""], dtype=np.int64)


def _along(row: np.ndarray, step: int | float) -> np.ndarray:
    """The least of each value and of those before it with ``step`` added for every place between."""
    place = np.arange(len(row)) * step
    return np.minimum.accumulate(row - place) + place


@F.pandas_udf(DoubleType())
def normalised_cer(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    """Errors by errors and correct characters, in percent, along one best alignment; null counts as empty."""
    error = 1 << 32  # an error outweighs any number of correct characters, which count as -1 each
    out = []
    for p, r in zip(map(_points, predicted), map(_points, reference)):
        row = np.arange(len(r) + 1) * error
        for c in p:
            above = row + error
            above[1:] = np.minimum(above[1:], row[:-1] + np.where(r == c, -1, error))
            row = _along(above, error)
        errors = -(-int(row[-1]) // error)
        correct = errors * error - int(row[-1])
        out.append(100 * errors / (errors + correct) if errors + correct else 0.0)
    return pd.Series(out, dtype=float)


def _swaps(p: np.ndarray, r: np.ndarray, costs: dict[tuple[int, int], float]) -> float:
    """Edit distance in which a swap of neighbours is one edit and some replacements cost less."""
    cheap: dict[int, dict[int, float]] = {}
    for (a, b), cost in costs.items():
        cheap.setdefault(a, {})[b] = cost
    row, before = np.arange(len(r) + 1, dtype=float), None
    for i, c in enumerate(p):
        replaced = (r != c).astype(float)
        for b, cost in cheap.get(int(c), {}).items():
            replaced[r == b] = cost
        above = row + 1
        above[1:] = np.minimum(above[1:], row[:-1] + replaced)
        if i:
            crossed = np.flatnonzero((r[:-1] == c) & (r[1:] == p[i - 1])) + 2
            above[crossed] = np.minimum(above[crossed], before[crossed - 2] + 1)
        row, before = _along(above, 1.0), row
    return float(row[-1])


def weighted_distance(costs: dict[tuple[str, str], float] | None = None) -> Callable[..., Column]:
    """A function of two text columns: their edit distance with swaps, where ``costs`` has what (predicted, reference)
    characters that are often confused cost to replace."""
    by_point = {(ord(a), ord(b)): cost for (a, b), cost in (costs or {}).items()}

    @F.pandas_udf(DoubleType())
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_swaps(p, r, by_point) for p, r in zip(map(_points, left), map(_points, right))], dtype=float)

    return distance


def damerau_levenshtein(left: Column, right: Column) -> Column:
    """Edit distance in which a swap of neighbours is one edit; null counts as empty."""
    return weighted_distance()(left, right).cast("int")


def field_accuracy(predicted: Column, reference: Column) -> Column:
    """Share of reference values found."""
    return F.when(F.size(reference) > 0, F.size(F.array_intersect(predicted, reference)) / F.size(F.array_distinct(reference)))


def overall_score(cer_: Column, wer_: Column, ious: Column, accuracies: Column) -> Column:
    mean = lambda a: F.coalesce(F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.size(a)), F.lit(None))
    return 0.5 * F.greatest(F.lit(0.0), 100 - (cer_ + wer_) / 2) + 0.3 * F.coalesce(mean(ious) * 100, F.lit(50.0)) + 0.2 * F.coalesce(mean(accuracies), F.lit(50.0))


def grade(cer_: Column, wer_: Column) -> Column:
    out = F.lit("POOR")
    for name, c, w in (("MODERATE", 10, 20), ("GOOD", 5, 10), ("EXCELLENT", 2, 5)):
        out = F.when((cer_ <= c) & (wer_ <= w), name).otherwise(out)
    return out


def technical_accuracy(predicted: Column, reference: Column) -> Column:
    """Group of terms -> share of those in the reference that the prediction has too; groups without any are left out."""
    shares = []
    for group, terms in ENGINEERING_TERMS.items():
        named = F.array(*[F.lit(t.lower()) for t in dict.fromkeys(terms)])
        wanted = F.filter(named, lambda t: F.contains(F.lower(reference), t))
        found = F.filter(wanted, lambda t: F.contains(F.lower(predicted), t))
        shares.append(F.struct(F.lit(group).alias("group"), F.try_divide(F.size(found), F.size(wanted)).alias("share")))
    return F.map_from_entries(F.filter(F.array(*shares), lambda s: s["share"].isNotNull()))


def match_rate(predicted: DataFrame, reference: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, match_rate: the share of the reference's (category, value) matches that the prediction has, whatever their case."""
    plain = lambda df: df.select(key, "category", F.lower("value").alias("value")).distinct()
    both = plain(reference).join(plain(predicted).withColumn("found", F.lit(1)), [key, "category", "value"], "left")
    return both.groupBy(key).agg(F.avg(F.coalesce("found", F.lit(0)).cast("double")).alias("match_rate"))


def recommendations(cer_: Column, wer_: Column, iou_: Column) -> Column:
    return F.array_compact(F.array(F.when(cer_ > 5, "improve character recognition"), F.when(wer_ > 10, "improve word recognition"), F.when(iou_ < 0.5, "improve localisation")))


def report(metrics: DataFrame) -> DataFrame:
    """``metrics`` (cer, wer, iou_scores, field_accuracy: a map) with overall_score, grade and recommendations."""
    c, w, ious = F.col("cer"), F.col("wer"), F.col("iou_scores")
    mean = F.try_divide(F.aggregate(ious, F.lit(0.0), lambda x, y: x + y), F.size(ious))
    return metrics.withColumns({"overall_score": overall_score(c, w, ious, F.map_values("field_accuracy")), "grade": grade(c, w), "recommendations": recommendations(c, w, mean)})


def compared(predicted: DataFrame, truth: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(pairs, missing): predictions beside the valid ground truth of their document, and truth without a prediction."""
    known = valid_truth(truth)
    return predicted.join(known, key), known.join(predicted.select(key), key, "left_anti")


def valid_truth(truth: DataFrame) -> DataFrame:
    """Ground truth with a text and a source."""
    return truth.where("reference_text != '' and source_file != ''")


def share_columns(value: str = "iou") -> list[Column]:
    return [F.avg(value).alias("mean_iou"), *[F.avg((F.col(value) >= t).cast("double")).alias(f"iou_at_{int(t * 100)}") for t in (0.5, 0.75)]]


def share_above(ious: DataFrame, value: str = "iou") -> DataFrame:
    return ious.agg(*share_columns(value))


def average_precision(detections: DataFrame, n_truth: int) -> DataFrame:
    """threshold, ap of detections (confidence, iou), one truth box each, at 0.50, 0.55 ... 0.95; the mean is mAP.

    Detections are ranked once, in slices of the confidence: a row of the rank within its slice, and a few sums per slice
    of what lies before it, so that no task holds all of them.
    """
    thresholds = [x / 100 for x in range(50, 100, 5)]
    n_slices = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = detections.select(F.percentile_approx("confidence", [k / n_slices for k in range(1, n_slices)] or [0.5], 10_000)).first()[0] or []
    # equal confidences are in one slice; few cuts, as many as there are partitions
    sliced = detections.withColumn("_slice", -F.size(F.filter(F.lit(sorted(set(cuts))).cast("array<double>"), lambda c: c < F.col("confidence"))))
    hits = [F.sum((F.col("iou") >= t).cast("long")).alias(f"h{k}") for k, t in enumerate(thresholds)]
    totals = sliced.groupBy("_slice").agg(F.count("*").alias("n"), *hits)
    over = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    names = ["n", *(f"h{k}" for k in range(len(thresholds)))]
    before = totals.select("_slice", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"before_{c}") for c in names])
    by = Window.partitionBy("_slice").orderBy(F.desc("confidence"), F.desc("iou"))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(F.broadcast(before), "_slice").select("*", (F.col("before_n") + F.row_number().over(by)).alias("rank"), *[(F.col(f"before_h{k}") + F.sum((F.col("iou") >= t).cast("long")).over(upto)).alias(f"hits{k}") for k, t in enumerate(thresholds)])
    gained = [F.coalesce(F.sum(F.when(F.col("iou") >= t, F.col(f"hits{k}") / F.col("rank"))), F.lit(0.0)) for k, t in enumerate(thresholds)]
    row = ranked.agg(*[(g / n_truth).alias(f"ap{k}") for k, g in enumerate(gained)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"ap{k}").alias("ap")) for k, t in enumerate(thresholds)])).alias("r")).select("r.threshold", "r.ap")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similarity(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


#: Frequent short words by language, for a vote.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "are"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "ein", "den", "von"),
    "fr": ("le", "la", "et", "les", "des", "est", "une", "dans", "pour", "que"),
    "es": ("el", "los", "y", "de", "que", "en", "una", "por", "con", "para"),
}


def likely_language(text: Column) -> Column:
    """The language with most of its stop words among the words of the text; ``unknown`` without any."""
    return bound(words(F.lower(text)), lambda ws: first_best([(name, F.size(F.filter(ws, lambda w: w.isin(*own)))) for name, own in STOP_WORDS.items()], "unknown"))


def keywords(docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, word, n, rank: the ``k`` most frequent words of four letters or more that are no stop words; ties by name."""
    stop = [w for own in STOP_WORDS.values() for w in own]
    word = docs.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("word"))
    counted = word.where(~F.col("word").isin(*stop)).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    by = Window.partitionBy(id_col).orderBy(F.desc("n"), "word")
    return counted.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def clean_text(text: Column) -> Column:
    """One space for white space, none at the ends, no control characters."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"\p{Cc}", ""))
