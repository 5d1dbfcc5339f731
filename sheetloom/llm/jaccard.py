"""Near-duplicate join of documents on the Jaccard similarity of their word shingles, as components.

Token-combination prefixes: the tokens (shingles) of a document are ordered from rare to frequent by
the class of their document frequency. A document's prefix is extended until any partner similar
enough must share with it a rare token or a pair of frequent ones of one group; rare tokens are
indexed alone and frequent ones as pairs, so that a line or passage that many documents hold makes no
candidates by itself. Candidates are verified by exact intersection of the 64-bit token sets.

Equal sets are one node from the start. Inside a key's documents no list of all pairs is made: they
are first compared with one leader, the one with the smallest share of tokens that no other document
has, and then only documents that the leader did not reach with the rest, where the parity bitmaps of
both sets leave room for the similarity. The bitmaps never rule out a similar pair.

Keys that many documents share, sets that many copies have, leaders, hubs and roots are joined so that none of
them gathers its rows in one task (``shared.meet``).

Defined cases: null and wordless texts have an empty set and no links; a text of fewer words than a
shingle is one token; very long texts are whole; rows with equal ids are separate documents that report the same id; a null id
names no component unless all of its documents have none; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sheetloom.llm import words as W
from sheetloom.llm.exchange import ask, bucket_count, cut, key_bits, packed, rows_of, small_batches, text_bytes, texts_of, told, unpack, with_answers
from sheetloom.llm.shared import HOT, meet, only, tidy, written

SHINGLE, PERCENT = 5, 80
#: Document frequencies from here on make a token frequent: it is indexed in pairs.
FREQUENT = 64
#: Frequent tokens that a pair may combine share one group; a document of 2**k tokens sees 2**k / GROUP groups.
GROUP = 16

#: 64-bit words of a set's parity bitmap.
BITMAP = 16

SETS, TOKENS = 0, 1
_U = np.uint64


def _token_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct token hashes of each text."""
    w = W.split(texts, lower=True)
    every = W.windows(w.hashes, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(W.windows(w.hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def _resolve(kind: int, keys: list[np.ndarray], values: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], list[int]]:
    every = np.concatenate(keys)
    model, index = np.unique(every, return_inverse=True)
    if kind == SETS:  # the first block that has a set keeps it
        out = np.zeros(len(every), dtype=_U)
        out[np.unique(index, return_index=True)[1]] = 1
    else:  # document frequency as a power of two, rounded down
        count = np.bincount(index, weights=np.concatenate([v[0] for v in values]), minlength=len(model))
        out = np.floor(np.log2(np.maximum(count, 1))).astype(_U)[index]
    return [[x] for x in np.split(out, np.cumsum([len(k) for k in keys])[:-1])], []


def _missing(n: int, percent: int) -> int:
    """Most tokens of a set of n that a similar partner may lack."""
    return n - -(-percent * n // 100)


def signatures(tokens: np.ndarray, level: np.ndarray, percent: int = PERCENT, frequent: int = FREQUENT) -> np.ndarray:
    """Index keys of one set; any two sets whose similarity reaches ``percent`` have one in common.

    level: the power of two of each token's document frequency. The order is by level and then hash, the same
    for all documents. Each rare token of the prefix stands for one missing token, each frequent one but the
    first of its group likewise; the prefix ends when they are more than a similar partner may lack. Groups
    depend on the larger set's size class, so a set near a class border writes its pairs for both classes.
    """
    n = len(tokens)
    need = _missing(n, percent) + 1
    order = np.lexsort((tokens, level))
    tokens, level = tokens[order], level[order]
    rare = (1 << level.astype(np.int64)) < frequent
    n_rare = int(rare.sum())
    if n_rare >= need:
        head = slice(0, need)
        return tokens[head][level[head] > 0]  # a token of one document finds none
    out = [tokens[:n_rare][level[:n_rare] > 0]]
    need -= n_rare
    rest = tokens[n_rare:]
    own = n.bit_length()
    largest = n * 100 // percent  # of a similar partner
    for size in {own, largest.bit_length()}:
        groups = max(1, (1 << size) // 2 // GROUP)
        group = W.mix(rest ^ _U(size)) % _U(groups)
        seen: dict[int, list[int]] = {}
        got = 0
        for g, t in zip(group.tolist(), rest.tolist()):
            held = seen.setdefault(g, [])
            got += bool(held)
            held.append(t)
            if got >= need:
                break
        pairs = [(a, b) for held in seen.values() for a, b in combinations(sorted(held), 2)]
        if pairs:
            both = np.array(pairs, dtype=_U)
            out.append(W.mix(both[:, 0] * _U(0x9E3779B97F4A7C15) ^ W.mix(both[:, 1] + _U(size))))
    return np.concatenate(out)


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bit h mod size is set if an odd number of tokens fall on it, so bitmaps differ in at most as many bits as sets in tokens."""
    size = 64 * BITMAP
    odd = np.bincount((W.mix(tokens) % _U(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _room(n: Column, m: Column, left: Column, right: Column, percent: int) -> Column:
    """False only if the similarity of two sets of n and m tokens is surely less."""
    differ = sum((F.bit_count(F.get(left, k).bitwiseXOR(F.get(right, k))) for k in range(BITMAP)), F.lit(0))
    return differ * (100 + percent) <= (n + m) * (100 - percent)


def _members(blocks: DataFrame, kind: str, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """id (of type ``kind``), place (block_id, at) of its row, n_shingles, node (null for an empty set), and for one document
    of each set keys and tokens if it has keys."""
    n_bytes = text_bytes(blocks)
    n_buckets, bits = bucket_count(blocks.sparkSession, n_bytes), key_bits(n_bytes, 10)

    def sets_of(row: dict) -> tuple[pa.Table, list[np.ndarray], list[bytes | None], np.ndarray, np.ndarray]:
        table = unpack(row["payload"])
        sets = _token_sets(texts_of(table, text_col), size)
        nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        keys = np.array([int.from_bytes(x[:8]) if x else 0 for x in nodes], dtype=_U)
        some = np.flatnonzero([x is not None for x in nodes])
        distinct, first = np.unique(keys[some], return_index=True)
        return table, sets, nodes, distinct, some[first]

    def emit_sets(row: dict) -> list:
        *_, distinct, _ = sets_of(row)
        return [(SETS, distinct, [])]

    def own_sets(row: dict) -> tuple:
        table, sets, nodes, distinct, first = sets_of(row)
        (mine,) = told(row, "sets", SETS, distinct, n_buckets, 1)
        return table, sets, nodes, first[mine > 0]

    def tokens_of(sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        every = np.concatenate([sets[k] for k in own]) if len(own) else np.zeros(0, dtype=_U)
        return cut(every, bits)

    def emit_tokens(row: dict) -> list:
        _, sets, _, own = own_sets(row)
        keys, counts = np.unique(tokens_of(sets, own), return_counts=True)
        return [(TOKENS, keys, [counts.astype(_U)])]

    settings = {"n_values": {SETS: 0, TOKENS: 1}, "bits": {SETS: 64, TOKENS: bits}}
    sets = ask(blocks, emit_sets, _resolve, n_buckets, **settings, name="jaccard-sets")
    tokens = ask(with_answers(blocks, sets=sets), emit_tokens, _resolve, n_buckets, **settings, name="jaccard-tokens")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            table, sets, nodes, own = own_sets(row)
            every = tokens_of(sets, own)
            keys, index = np.unique(every, return_inverse=True)
            level = told(row, "tokens", TOKENS, keys, n_buckets, 1)[0][index]
            found: list = [None] * len(sets)
            blobs: list = [None] * len(sets)
            alone: list = [None] * len(sets)
            bits: list = [None] * len(sets)
            at = 0
            for k in own.tolist():
                n = len(sets[k])
                marks = signatures(sets[k], level[at : at + n], percent)
                alone[k] = int((level[at : at + n] == 0).sum()) * 1000 // n
                at += n
                if len(marks):
                    found[k], blobs[k], bits[k] = marks.view(np.int64), sets[k].tobytes(), _bitmap(sets[k])
            n_own = pa.array([len(s) for s in sets], pa.int64())
            ids = table.column(id_col).combine_chunks()
            block, at_row = pa.array(np.full(len(sets), row["block_id"]), pa.int64()), pa.array(np.arange(len(sets)), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, block, at_row, n_own, pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(blobs, pa.binary()), pa.array(alone, pa.int32()), pa.array(bits, pa.list_(pa.int64()))], names=["id", "block_id", "at", "n", "node", "keys", "tokens", "alone", "bits"])

    described = with_answers(blocks, sets=sets, tokens=tokens).mapInArrow(tidy(describe), f"id {kind}, block_id long, at int, n long, node binary, keys array<long>, tokens binary, alone int, bits array<long>")
    with small_batches(blocks.sparkSession):
        return written(described, "jaccard-members")


#: Pairs of one document that verification deals to a task, at least.
DEALT = 256


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches ``percent``. ``pairs`` is a written table.

    The pairs of one ``a`` are dealt to as many tasks as they fill, each with a copy of its tokens; a ``b`` has no more
    pairs than keys.
    """
    of = written(pairs.groupBy("a").agg(F.count("*").alias("m")), "jaccard-degrees")
    most = max(DEALT, (of.agg(F.sum("m")).first()[0] or 0) // HOT)
    shares = F.ceil(F.col("m") / most).cast("int")
    dealt = meet(pairs, of, "a", inner=True).select("a", "b", F.pmod(F.xxhash64("b"), shares).cast("int").alias("share"))
    left = tokens.join(of, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.col("tokens").alias("left"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("right"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return dealt.join(left, ["a", "share"]).join(right, "b").select("a", "b", "left", "right").mapInArrow(tidy(check), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest node that it reaches.

    Rounds of taking the smallest root among neighbours and then the root's own root, until none changes; every
    round is a written table, and neither a hub's links nor the nodes of one root come together in a task.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"), F.count("*").alias("m")), "roots")
    while True:
        heard = meet(both, roots.select(F.col("node").alias("b"), "root", "m"), "b", inner=True).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        best = written(roots.join(heard, "node").select("node", "root", F.col("m").alias("degree"), F.least("root", "heard").alias("best")), "roots")
        above = best.groupBy("best").agg(F.count("*").alias("m")).join(roots.select(F.col("node").alias("best"), F.col("root").alias("top")), "best")
        next_ = F.least("best", "top")
        moved = meet(best, written(above, "tops"), "best", inner=True).select("node", next_.alias("root"), F.col("degree").alias("m"), (next_ != F.col("root")).alias("changed"))
        roots = written(moved, "roots")
        if roots.where("changed").isEmpty():
            return roots.select("node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id: the smallest id that a document reaches by links, its own included.

    Two documents link when the Jaccard similarity of their sets of ``size``-word shingles (A-Z lower-cased, words
    without ASCII white space) is ``percent`` / 100 or more.
    """
    blocks = packed(only(docs, id_col, text_col), text_col, "jaccard-blocks")
    members = _members(blocks, docs.schema[id_col].dataType.simpleString(), id_col, text_col, size, percent)
    found = meet(members.select("id", "n", "node"), _named(members, percent), "node")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id"))


def _named(members: DataFrame, percent: int) -> DataFrame:
    """node, m (its documents) and the first document of its component for every set, as a written table.

    The first has the smallest id, a null id comes last, and of rows of one id the first by its place.
    """
    roots = _linked(members, percent)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "block_id", "at")
    per_node = members.where("node is not null").groupBy("node").agg(F.count("*").alias("m"), F.min(place).alias("least"))
    rooted = written(per_node.join(roots, "node", "left").select("node", F.col("m").alias("copies"), "least", F.coalesce("root", "node").alias("root")), "jaccard-rooted")
    least = written(rooted.groupBy("root").agg(F.count("*").alias("m"), F.min("least").alias("first")), "jaccard-least")
    return written(meet(rooted, least, "root", inner=True).select("node", F.col("copies").alias("m"), "first"), "jaccard-named")


def _linked(members: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the sets that link with another."""
    spark = members.sparkSession
    owners = members.where("keys is not null")
    tokens = owners.select("node", "tokens")
    postings = owners.select("node", "n", "alone", F.explode("keys").alias("key")).distinct()
    leader = F.min(F.struct("alone", "node", "n")).alias("leader")
    shared = written(postings.groupBy("key").agg(F.count("*").alias("m"), leader).where("m > 1"), "jaccard-keys")
    postings = written(meet(postings, shared, "key", inner=True).select("key", "node", "n", "alone", "leader"), "jaccard-postings")
    enough = F.least("n", "k") * 100 >= F.greatest("n", "k") * percent
    led = postings.select("node", "n", F.col("leader.node").alias("a"), F.col("leader.n").alias("k"))
    pairs = written(led.where((F.col("a") != F.col("node")) & enough).select("a", F.col("node").alias("b")).distinct(), "jaccard-pairs")
    with small_batches(spark):
        links = written(_verified(pairs, tokens, percent), "jaccard-links")
    # what the leaders did not link: the rest of a key's documents, where sizes and bitmaps leave room
    rooted = written(postings.drop("leader").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-rooted")
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"), F.min(F.struct("alone", "node", "root")).alias("leader"))
    split = written(split.where("low != high").select("key", "m", F.col("leader.root").alias("top")), "jaccard-open-keys")
    # sets of this similarity are of the same or of neighbouring classes of size
    band = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int")
    rooted = meet(rooted, split, "key", inner=True).withColumn("band", band if percent < 100 else F.col("n").cast("int"))
    rooted = written(rooted.join(owners.select("node", "bits"), "node").select("key", "band", "top", "root", "node", "n", "bits"), "jaccard-open")
    other = rooted.select("key", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), F.col("root").alias("their_root"), F.col("node").alias("b"), F.col("n").alias("k"), F.col("bits").alias("their_bits"))
    apart = (F.col("their_root") == F.col("top")) | (F.col("root") < F.col("their_root"))
    left_out = rooted.where(F.col("root") != F.col("top")).join(other, ["key", "band"])
    pairs = left_out.where(apart & enough & _room(F.col("n"), F.col("k"), F.col("bits"), F.col("their_bits"), percent)).select(F.col("node").alias("a"), "b").distinct()
    with small_batches(spark):
        return components(written(links.union(_verified(written(pairs, "jaccard-pairs"), tokens, percent)), "jaccard-links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id, a null id last, and of rows of one id the
    first by its place in the table. Documents without words link with nothing, and all of them stay, as do all columns.
    """
    blocks = packed(docs, text_col, "jaccard-blocks")
    members = _members(blocks, docs.schema[id_col].dataType.simpleString(), id_col, text_col, size, percent)
    found = meet(members.select("block_id", "at", "node"), _named(members, percent), "node", inner=True)
    gone = found.where((F.col("first.block_id") != F.col("block_id")) | (F.col("first.at") != F.col("at")))
    gone = gone.groupBy("block_id").agg(F.collect_list("at").alias("gone"))  # at most the rows of a block
    schema = to_arrow_schema(docs.schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            table = unpack(row["payload"])
            stays = np.ones(table.num_rows, dtype=bool)
            stays[row["gone"] or []] = False
            yield from table.filter(pa.array(stays)).cast(schema).to_batches()

    return blocks.join(gone, "block_id", "left").mapInArrow(tidy(keep), docs.schema)
