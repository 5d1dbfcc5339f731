"""Language identification word by word, with a back-off to shorter and shorter character n-grams.

A known word scores by its frequency in each language. A word that is not known scores by the longest of
its character n-grams that are. The model is fitted on a sample of the labelled rows, bounded for each language so that
a small one is not lost beside a large one, and keeps each language's most frequent words and n-grams; both bounds are
parameters. Every text is then judged whole, by its text alone. The language is the one with the largest sum of
evidence; the score is how sure an average word of the text makes it, so that mixed and strange texts score low
however long they are.

Defined cases: null text, or text without a letter, is ``und`` with score 0, as is all text if there was nothing to learn
from; a letterless or empty training text teaches nothing; repeated rows count as often as they are there; of languages that
tie the first by name is taken; very long texts are judged whole; an empty table gives no rows; further columns are kept, but
lang_pred and score are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.llm.shared import only, tidy, unused, written

UNDETERMINED = "und"
#: Labelled rows of each language that the model is fitted on, about, taken by the hash of their id; None for all.
SAMPLE: int | None = 6000
#: Words, and n-grams of each length, that the model keeps: of each language an equal share, the most frequent; None for all.
WORDS: int | None = 100_000
GRAMS: int | None = 50_000
LONGEST = 4
#: A text is rejected when its best language is less probable than this.
LEAST_SCORE = 0.5
_WORD = re.compile(r"[^\W\d_]+")

Model = tuple[list[str], dict[str, int], np.ndarray, dict[str, int], np.ndarray]


def held_out(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == 0


def grams_of(word: str, n: int) -> list[str]:
    whole = f"^{word}$"
    return [whole[i : i + n] for i in range(len(whole) - n + 1)] if n > 1 else list(word)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int | None = SAMPLE, words: int | None = WORDS, grams: int | None = GRAMS) -> Model:
    """From rows with text and language. What goes to the driver is the kept words and n-grams alone."""
    labelled = only(labelled, id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n_langs = labelled.select(lang_col).distinct().count()
    if sample:
        share = labelled.groupBy(F.col(lang_col).alias("of")).agg((F.lit(sample * (1 << 40)) / F.count("*")).alias("share"))
        dice = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 40))
        labelled = labelled.join(F.broadcast(share), F.col(lang_col) == F.col("of")).where(dice < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words = Counter(_WORD.findall(text.lower()))
                if words:
                    found.setdefault((lang, 0), Counter()).update(words)
        for (lang, _), words in list(found.items()):
            for k in range(1, LONGEST + 1):
                once = (w for w, m in words.items() if m == 1)
                grams = found[lang, k] = Counter(chain.from_iterable(map(grams_of, once, repeat(k))))
                for word, m in words.items():
                    if m > 1:
                        for g in grams_of(word, k):
                            grams[g] += m
        for (lang, k), counts in found.items():
            rows = list(counts.items())
            for lo in range(0, len(rows), 10_000):
                part = rows[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([k] * len(part), pa.int32()), pa.array([g for g, _ in part]), pa.array([m for _, m in part], pa.int64())], names=["lang", "k", "gram", "m"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(tidy(count), "lang string, k int, gram string, m long")
    summed = written(rows.groupBy("k", "gram", "lang").agg(F.sum("m").alias("m")), "langid-counts")
    kept = summed
    if words and grams:
        # the places of a language's rows from their counts alone: how many rows have each count, then how many more
        sizes = summed.groupBy("k", "lang", "m").agg(F.count("*").alias("n"))
        above = Window.partitionBy("k", "lang").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, 0)
        limit = F.when(F.col("k") == 0, -(-words // max(n_langs, 1))).otherwise(-(-grams // max(n_langs, 1)))
        enough = sizes.withColumn("upto", F.sum("n").over(above)).where(F.col("upto") - F.col("n") < limit)
        least = enough.groupBy(F.col("k").alias("of_k"), F.col("lang").alias("of")).agg(F.min("m").alias("least"))
        often = summed.join(F.broadcast(least), (F.col("k") == F.col("of_k")) & (F.col("lang") == F.col("of")))
        some = often.where((F.col("m") >= F.col("least")) & (F.col("m") > 1)).select("k", "gram").distinct()
        kept = summed.join(some, ["k", "gram"])
    found = kept.select("k", "gram", "lang", "m").toArrow()
    langs = sorted(pc.unique(found.column("lang")).to_pylist())
    column = pc.index_in(found.column("lang"), pa.array(langs, pa.string())).to_numpy()

    def table(rows: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
        coded = found.column("gram").take(pa.array(rows)).combine_chunks().dictionary_encode()
        m = np.zeros((len(coded.dictionary), len(langs)))
        m[coded.indices.to_numpy(), column[rows]] = found.column("m").to_numpy()[rows]
        logs = np.log((m + 0.5) / (m.sum(axis=0) + 0.5 * len(m))) if len(m) else m
        return {gram: i for i, gram in enumerate(coded.dictionary.to_pylist())}, logs

    k = found.column("k").to_numpy()
    return (langs, *table(np.flatnonzero(k == 0)), *table(np.flatnonzero(k > 0)))


class Scorer:
    """Sums of log frequencies by language. It keeps nothing of the texts it has judged."""

    def __init__(self, model: Model):
        self.langs, self.words, self.word_logs, self.grams, self.gram_logs = model

    def back_off(self, words: Iterable[str]) -> np.ndarray:
        """The sum, over ``words``, of the mean of the longest known n-grams of each; all words in one gather."""
        at: list[int] = []
        weight: list[float] = []
        known = self.grams.get
        for word in words:
            whole = f"^{word}$"
            for k in range(LONGEST, 0, -1):
                found = [i for g in range(len(whole) - k + 1) if (i := known(whole[g : g + k])) is not None] if k > 1 else [i for c in word if (i := known(c)) is not None]
                if found:
                    at += found
                    weight += [1 / len(found)] * len(found)
                    break
        return np.array(weight) @ self.gram_logs[at] if at else np.zeros(len(self.langs))

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int32, len(words))
        total = self.word_logs.take(at[at >= 0], axis=0).sum(axis=0)
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            total = total + self.back_off(map(words.__getitem__, unseen.tolist()))
        odds = np.exp((total - total.max()) / len(words))
        best = int(total.argmax())  # the first in order of name among ties
        return self.langs[best], float(odds[best] / odds.sum())


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the probability of that language by equal priors and one word of average evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        scorer = Scorer(shared.value)
        return pd.DataFrame([scorer(t) for t in texts], columns=["lang_pred", "score"])

    name = unused(docs, "judged")
    judged = docs.select("*", judge(F.coalesce(docs[f"`{text_col}`"], F.lit(""))).alias(name))
    kept = [judged[f"`{c}`"] for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return judged.select(*kept, F.col(f"{name}.lang_pred"), F.col(f"{name}.score"))


def trained(docs: DataFrame, parts: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fitted on the rows that ``held_out`` leaves."""
    return fit(docs.where(~held_out(F.col(id_col), parts)), id_col, text_col, lang_col)


def identified(docs: DataFrame, parts: int = 5) -> DataFrame:
    """``docs`` without the rows whose language stays undetermined or doubtful."""
    clash = [c for c in docs.columns if c.lower() in ("lang_pred", "score")]
    name = unused(docs, "row")  # columns of these names wait in a struct
    rows = docs.select("*", F.struct(*[docs[f"`{c}`"] for c in clash]).alias(name)) if clash else docs
    judged = predict(rows, trained(docs, parts)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return judged.select(*[F.col(f"{name}.`{c}`").alias(c) if c in clash else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, parts: int = 5) -> DataFrame:
    judged = predict(docs.select("doc_id", "text"), trained(docs, parts))
    return judged.select("doc_id", held_out(F.col("doc_id"), parts).alias("held_out"), "lang_pred", "score")
