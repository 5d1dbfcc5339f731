"""Every stage of the pipeline against a brute-force version, on what the stage before it kept."""

import base64
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_contracts import brute_contamination, lower, words

from sheetloom.llm import langid


def shingles(text):
    w = words(lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf_dir, tmp_path):
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, columns, kept = [r.asDict() for r in docs.collect()], docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = read(name)
        kept[name] = [r.asDict() for r in docs.collect()]
        assert docs.columns == columns or name == "tokens"
    ids = lambda found: sorted(r["doc_id"] for r in found)

    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer = langid.Scorer(langid.trained(first))
    judged = {r["doc_id"]: scorer(r["text"]) for r in before}
    assert ids(kept["language"]) == sorted(i for i, (lang, score) in judged.items() if lang != "und" and score >= langid.LEAST_SCORE)

    root, given = {}, kept["language"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in given}
    for i in sorted(sets):
        near = {root[j] for j in root if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        root[i] = min(near, default=i)
        root |= {j: root[i] for j in root if root[j] in near}
    left = ids(kept["near_copies"])
    assert sorted(root[i] for i in left) == sorted(set(root.values()))
    texts = {r["doc_id"]: r for r in given}
    assert all(r == texts[r["doc_id"]] for r in kept["near_copies"])

    starts, expected = Counter(), {}
    given = {r["doc_id"]: words(r["text"]) for r in kept["near_copies"]}
    for w in given.values():
        starts.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    for i, w in given.items():
        gone = {j for k in range(len(w) - 34) if starts[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        if not gone or len(gone) < len(w):
            expected[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else texts[i]["text"]
    assert {r["doc_id"]: r["text"] for r in kept["passages"]} == expected

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [i for i, *_, contaminated in brute_contamination(list(expected.items()), items) if not contaminated]
    assert ids(kept["benchmark"]) == sorted(clean)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: r["n_tokens"] for r in kept["tokens"]} == {i: len(plain.encode_ordinary(expected[i])) for i in clean}
    assert all(r["round_trip"] for r in kept["tokens"])


WORDS = [f"word{k}" for k in range(200)]
LONG = "the and of to in is that for with are " * 4


def test_stages_on_null_and_repeated_ids_empty_texts_and_more_columns(spark, sf_dir, tmp_path):
    """Every stage judges rows: what goes is by the row's own text, whatever its id."""
    item = " ".join(f"item{k}" for k in range(30))
    passage = " ".join(f"passage{k}" for k in range(60))
    given = [
        (None, LONG + "one of a kind", "en"),
        (None, item, "en"),
        (1, item, "en"),
        (1, LONG + "clean under the same id as another row", "en"),
        (2, LONG + "copy " * 30, "en"),
        (2, LONG + "copy " * 30, "en"),
        (3, None, None),
        (4, "", "en"),
        (5, "12 34 !", "en"),
        (6, passage + " " + " ".join(WORDS[:80]), "en"),
        (7, passage + " " + " ".join(WORDS[100:190]), "en"),
        (8, passage, "en"),
    ]
    shape = "doc_id long, text string, lang string, source string, n_chars long, n_hit int, node string, gone string, lang_pred string"
    docs = spark.createDataFrame([(*g, "s", len(g[1] or ""), 7, "n", "g", "l") for g in given], shape)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    apply = lambda name, df: stages[name](spark, df, str(tmp_path))
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    of = lambda rows: sorted(((g[0], g[1]) for g in rows), key=repr)

    for name in ("language", "near_copies", "passages", "benchmark"):
        found = apply(name, docs)
        assert found.columns == docs.columns and {(r["n_hit"], r["node"], r["lang_pred"]) for r in found.collect()} == {(7, "n", "l")}, name
        assert apply(name, docs.limit(0)).collect() == [], name
    assert pairs(apply("language", docs)) == of([g for g in given if any(c.isalpha() for c in g[1] or "")])
    left = pairs(apply("near_copies", docs))
    assert left == of([g for k, g in enumerate(given) if k not in (1, 5)])  # of the item's two rows the one with an id stays
    assert pairs(apply("benchmark", docs)) == of([g for g in given if g[1] != item])
    cut = dict(pairs(apply("passages", docs.where("doc_id > 2"))))
    assert cut == {3: None, 4: "", 5: "12 34 !", 6: " ".join(WORDS[:80]), 7: " ".join(WORDS[100:190])}  # of the eighth nothing stays
    tokens = apply("tokens", docs).collect()
    assert len(tokens) == len(given) and all(r["round_trip"] for r in tokens) and {r["n_tokens"] for r in tokens if r["doc_id"] in (3, 4)} == {0}
    assert apply("tokens", docs.limit(0)).collect() == []
