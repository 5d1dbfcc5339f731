"""op4 with two words of context, against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from sheetloom.llm import queries


def test_the_query_has_two_words_of_context(spark, tmp_path):
    texts = ["a b c a b d", "b c a b c", "a b c d e a b c", "c b a", "", None, "x a b c", "a b d b d a", "d e a b", "e a b c a", "never seen a b", "b b b b c"] * 2
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    grams = {3: Counter()}
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 10:
            w = ["<s>", "<s>", *(t or "").split(), "</s>"]
            grams[3].update(zip(w, w[1:], w[2:]))
    for m in (2, 1):  # how many different words stand before
        grams[m] = Counter(g[1:] for g in grams[m + 1])
    types = {g[-1] for g in grams[1]}

    def discounts(counts):
        m = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if all(m):
            y = m[0] / (m[0] + 2 * m[1])
            d = [0, *(k - (k + 1) * y * m[k] / m[k - 1] for k in (1, 2, 3))]
            if all(0 < d[k] < k for k in (1, 2, 3)):
                return d
        return [0, 0.5, 1.0, 1.5]

    d = {m: discounts(c) for m, c in grams.items()}
    after = {m: defaultdict(list) for m in grams}
    for m, counts in grams.items():
        for g, c in counts.items():
            after[m][g[:-1]].append(c)

    def p(gram):
        m, seen = len(gram), after[len(gram)][gram[:-1]]
        lower = p(gram[1:]) if m > 1 else 1 / (len(types) + 1)
        if not seen:
            return lower
        c = grams[m][gram]
        return (max(c - d[m][min(c, 3)], 0) + sum(d[m][min(x, 3)] for x in seen) * lower) / sum(seen)

    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op4_ngram_lm"](spark, str(tmp_path)).collect()}
    for i, t in docs:
        w = ["<s>", "<s>", *(t or "").split(), "</s>"]
        assert got[i] == pytest.approx(sum(math.log10(p(g)) for g in zip(w, w[1:], w[2:])), rel=1e-9, abs=1e-9), t
