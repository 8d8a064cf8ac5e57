"""Near copies: texts whose sets of word shingles have a Jaccard index of NUM / DEN or more.

Every link is verified on the exact shingle sets.  Candidates come from SimHash
views (vantage-point trees, see ``simhash``) and from an exact prefix join: in an
order of all shingles that puts common ones last, two sets that similar share one
of their first ``n - ceil(n * NUM / DEN) + 1`` shingles, so no pair is missed.

Texts with equal sets are one node.  A first round takes the SimHash links and, per shingle,
the pairs with its star: the node that has it nearest to the front, so with the fewest rarer
shingles of its own, which is the middle of a group of edited copies.  What links is
contracted.  The last round takes every pair of different components that is left and whose
places of the shingle still allow enough in common; in the smaller set, only a place among
the first ``n * (DEN - NUM) / (DEN + NUM)`` does.  Pairs are compared by their prefixes, and
by their whole sets if those share enough.  Shingles in more than MOST nodes are joined block
by block.

The order is by counts over a sample of texts (1 of SAMPLE): any order that is the
same for all texts is exact, a better one only makes fewer candidates.

Edge cases: null texts are empty and form one node, as do texts with less words than
a shingle that have the same ones; null and repeated ids do no harm, rows are told apart
by their texts; repeated rows are one node and each gets its row; a very long text is one
set, in one row of a batch; further columns are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discarded, in_chunks, materialised, text_or_empty
from .components import connected_components

#: The least Jaccard index.
NUM, DEN = 4, 5

#: One of so many texts is counted for the order; its most common shingles at most.
SAMPLE, COMMON = 16, 1 << 17

#: Nodes of a shingle that are joined at once, on either side.
MOST = 2000


def _set_of(text: str, words: int) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, words))


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least three sampled texts, sorted, and in how many."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            sets = [_set_of(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["key"])

    sampled = texts.filter(F.pmod("th", F.lit(SAMPLE)) == 0).dropDuplicates(["th"]).select("text")
    counts = sampled.mapInArrow(spread, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()  # COMMON rows
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top.column("n").to_numpy()[order]


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, of a sorted set."""
    n = len(shingles)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        hit = common[at] == shingles
        often = shingles[hit]
        shingles = np.concatenate([shingles[~hit], often[np.argsort(counts[at[hit]], kind="stable")]])
    return shingles[: n - -(-n * NUM // DEN) + 1]


def _described(texts: DataFrame, words: int, views: int) -> DataFrame:
    """(doc_id, th, views, node, n, keys) for each row."""
    names = simhash.view_columns("fp", views)
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in in_chunks(batches, "text"):
            prints, nodes, sizes, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                h = simhash.shingle_hashes(text, words)
                prints.append(simhash.set_bits(h, views) * 2 > len(h))
                h = np.unique(h)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes()))
                sizes.append(len(h))
                keys.append(prefix(h, *shared.value).view(np.int64))
            packed = np.packbits(np.array(prints), axis=2, bitorder="little").view("<i8")[:, :, 0]
            ends = np.cumsum([0, *map(len, keys)])
            columns = [pa.array(np.ascontiguousarray(packed[:, v])) for v in range(views)]
            columns += [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32())]
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *columns], ["doc_id", "th", *names, "node", "n", "keys"])

    fields = ", ".join(f"{c} long" for c in (*names, "node"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, th long, {fields}, n int, keys array<long>")


def _possible(n: str, i: str, m: str, j: str) -> Column:
    """Whether sets of n and m shingles that share those at places i and j can be similar
    enough, if it is the first they share."""
    return (DEN + NUM) * F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= NUM * (F.col(n) + F.col(m))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough.

    Of two prefixes the one that ends first hides at most its set's rest, so what two sets
    have in common is at most the shared prefix shingles and that rest."""
    left, right = (nodes.select(F.col("node").alias(p), F.col("n").alias(f"n_{p}"), F.col("keys").alias(f"keys_{p}")) for p in "ab")
    rest = F.greatest(*(F.col(f"n_{p}") - F.size(f"keys_{p}") for p in "ab"))
    enough = (DEN + NUM) * (F.size(F.array_intersect("keys_a", "keys_b")) + rest) >= NUM * (F.col("n_a") + F.col("n_b"))
    return pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "th"), "node")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            sets = [_set_of(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), arrays], ["node", "hashes"])

    one_each = texts.select("th", "text").join(wanted, "th").dropDuplicates(["node"])
    sets = materialised(one_each.select("node", "text").mapInArrow(hashed, "node long, hashes array<long>"))
    left, right = (sets.select(F.col("node").alias(p), F.col("hashes").alias(h)) for p, h in (("a", "x"), ("b", "y")))
    # pairs stream past one by one: long texts never gather in a batch
    enough = (DEN + NUM) * F.size(F.array_intersect("x", "y")) >= NUM * (F.size("x") + F.size("y"))
    kept = materialised(pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b"))
    discarded(sets)
    return kept


def _left(known: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that share a shingle at possible places."""
    of_key = known.groupBy("key").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high"))
    parts = of_key.filter("low <> high").select("key", F.ceil(F.col("many") / MOST).cast("int").alias("parts"))
    met = materialised(known.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))

    def side(p: str, own: str, other: str) -> DataFrame:
        named = (F.col(c).alias(f"{c}_{p}") for c in ("node", "n", "pos", "root"))
        return met.select("key", F.col("own").alias(own), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(other), *named)

    # the smaller set is on the left, in block i; the larger in block j
    small = side("l", "i", "j").filter((DEN + NUM) * F.col("pos_l") <= (DEN - NUM) * F.col("n_l"))
    both = small.join(side("r", "j", "i"), ["key", "i", "j"]).filter(F.struct("n_l", "node_l") < F.struct(F.col("n_r").alias("n_l"), F.col("node_r").alias("node_l")))
    both = both.filter((F.col("root_l") != F.col("root_r")) & _possible("n_l", "pos_l", "n_r", "pos_r"))
    left = materialised(both.select(*_ordered("node_l", "node_r")).distinct())
    discarded(met)
    return left


def groups(df: DataFrame, words: int, views: int, radius: int, limit: int) -> DataFrame:
    """(doc_id, th, near) per row of ``df`` (doc_id, text): the hash of the text, and a
    number that rows share which chains of near copies connect."""
    texts = df.select("doc_id", text_or_empty("text").alias("text")).withColumn("th", F.xxhash64("text"))
    names = simhash.view_columns("fp", views)
    rows = materialised(_described(texts, words, views))
    first = rows.groupBy("node").agg(F.min(F.struct("th", *names)).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = materialised(first.select("node", "row.*", "n", "keys"))
    placed = nodes.select(F.posexplode("keys").alias("pos", "key"), "node", "n")
    # most shingles are in one set only: they go before anything is gathered by the others
    shared = placed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").select("key")
    common = materialised(placed.join(shared, "key").select("key", "node", "n", "pos"))
    stars = common.groupBy("key").agg(F.min(F.struct("pos", "node", "n")).alias("star")).select("key", *(F.col(f"star.{c}").alias(f"star_{c}") for c in ("pos", "node", "n")))
    met = common.join(stars, "key").filter((F.col("node") != F.col("star_node")) & _possible("n", "pos", "star_n", "star_pos"))
    proposed = simhash.links(nodes, radius, names, limit).select(*_ordered("a", "b"))
    tried = materialised(met.select(*_ordered("node", "star_node")).unionByName(proposed).distinct())
    edges = verified(materialised(likely(tried, nodes)), nodes, texts, words)
    roots = connected_components(edges).select("node", "root")
    known = materialised(common.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    left = _left(known).join(tried, ["a", "b"], "left_anti")
    edges = edges.unionByName(verified(materialised(likely(left, nodes)), nodes, texts, words))
    for table in (common, known, tried):
        discarded(table)
    roots = connected_components(edges).select("node", "root")
    return rows.select("doc_id", "th", "node").join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("near"))
