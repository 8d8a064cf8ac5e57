"""SimHash near-duplicates, linked exactly through vantage-point trees.

Fingerprints are 64 bits over word shingles.  Pairs within ``radius`` bits are
found with vantage-point trees: a node holds a fingerprint and a distance, what
lies within that distance goes to the inner side, and what lies beyond it *less
the search radius* to the outer side.  By the triangle inequality both ends of
every wanted pair then share at least one leaf, so boundary-overlapping leaves
are searched on their own, each by one group of a shuffle.

A 64-bit search ball is wide for such trees, so one tree is grown for each of
``radius // 2 + 1`` bit blocks: a pair within the radius differs by at most one
bit in one of the blocks, and that block's tree overlaps by a single step.

Several fingerprints ("views") of a text can be searched side by side: documents then
link if one view is within the radius and all views together within ``limit`` bits.
That finds looser copies than one view and keeps chance neighbours of it apart.

The trees are fitted on a bounded sample of distinct fingerprints (SAMPLE); all
fingerprints are routed.  Leaves that turn out overfull are compared block by
block, so no task holds more than a few thousand fingerprints.  A leaf gives a
spanning forest of its links, not all pairs.

Edge cases: null texts are empty; texts without a word have fingerprint zero and
link like any other; equal fingerprints form one class before any search, so
repeated rows cost nothing; a null doc_id keeps its row and gets the smallest
non-null id of its component (null if there is none); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks, materialised, text_or_empty
from .components import connected_components

#: Distinct fingerprints that the trees are fitted on, at most.
SAMPLE = 1 << 17

#: Fingerprints wanted in a leaf, and compared by one task at most.
LEAF, MOST = 512, 8192


#: Salts of the views after the first, which is the plain hash.
_SALTS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _view(h: np.ndarray, number: int) -> np.ndarray:
    if not number:
        return h
    h = (h ^ np.uint64(_SALTS[number])) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The hash of every run of ``words`` words; of all words where there are fewer."""
    import xxhash

    tokens = text.encode().lower().split()  # bytes: A-Z alone, the six white-space bytes alone
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - span + 1
    out = np.empty(n, np.uint64)
    for at in range(0, n, 100_000):
        stop = min(n, at + 100_000)
        pairs = zip(starts[at:stop].tolist(), ends[at + span - 1 : stop + span - 1].tolist())
        out[at:stop] = np.fromiter((digest(joined[i:j], 42) for i, j in pairs), np.uint64, stop - at)
    return out


def set_bits(hashes: np.ndarray, views: int = 1) -> np.ndarray:
    """Per view the counts of set bits over all hashes."""
    counts = np.zeros((views, 64), np.int64)
    for at in range(0, len(hashes), 100_000):
        h = hashes[at : at + 100_000]
        for v in range(views):
            bits = np.unpackbits(_view(h, v).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[v] += bits.sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str, words: int, views: int = 1) -> tuple[np.ndarray, int]:
    """Per view the counts of set bits over all shingle hashes; and how many shingles."""
    hashes = shingle_hashes(text, words)
    return set_bits(hashes, views), len(hashes)


def with_fingerprint(df: DataFrame, text_col: str = "text", words: int = 5, out: str = "fp", views: int = 1) -> DataFrame:
    """``df`` with the fingerprint as a signed 64-bit integer in ``out``; further views in
    ``out`` followed by their number."""
    names = view_columns(out, views)
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "__text"):
            counted = [fingerprint(t, words, views) for t in batch.column("__text").to_pylist()]
            set_bits = np.array([c * 2 > n for c, n in counted])
            prints = np.packbits(set_bits, axis=2, bitorder="little").view("<i8")[:, :, 0]
            columns = [pa.array(np.ascontiguousarray(prints[:, v])) for v in range(views)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *names])

    return df.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(F.col(f"`{text_col}`")).alias("__text")).mapInArrow(run, schema)


def view_columns(column: str, views: int) -> list[str]:
    return [column, *(f"{column}{v}" for v in range(1, views))]


def bit_blocks(radius: int) -> list[int]:
    """Masks that cut 64 bits into radius // 2 + 1 blocks."""
    parts = radius // 2 + 1
    edges = [64 * i // parts for i in range(parts + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def grow(sample: np.ndarray, mask: int, reach: int, leaf: int) -> list[tuple[int, int, int, int]]:
    """A tree as rows (vantage point, distance, inner, outer); a leaf has distance -1
    and its number in place of a child."""
    rng, nodes, leaves = np.random.default_rng(0), [], 0
    todo = [(sample & np.uint64(mask), None, 0)]
    while todo:
        points, parent, side = todo.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent] = nodes[parent][: 2 + side] + (me,) + nodes[parent][3 + side :]
        best = None
        if len(points) > leaf:
            for vantage in rng.choice(points, 3):
                d = np.bincount(np.bitwise_count(points ^ vantage), minlength=66).cumsum()
                inner = d
                outer = len(points) - np.concatenate([np.zeros(reach, np.int64), d])[: len(d)]
                cost = inner.astype(float) ** 2 + outer.astype(float) ** 2
                cut = int(cost.argmin())
                if best is None or cost[cut] < best[0]:
                    best = cost[cut], int(vantage), cut
        if best is None or best[0] > 0.9 * len(points) ** 2:
            nodes.append((0, -1, leaves, 0))
            leaves += 1
            continue
        _, vantage, cut = best
        nodes.append((vantage, cut, -1, -1))
        d = np.bitwise_count(points ^ np.uint64(vantage))
        todo.append((points[d <= cut], me, 0))
        todo.append((points[d > cut - reach], me, 1))
    return nodes


def route(prints: np.ndarray, nodes: list, mask: int, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions of the fingerprints that belong to it), overlaps included."""
    points = prints & np.uint64(mask)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        vantage, cut, inner, outer = nodes[node]
        if not len(at):
            continue
        if cut < 0:
            yield inner, at
            continue
        d = np.bitwise_count(points[at] ^ np.uint64(vantage))
        todo.append((inner, at[d <= cut]))
        todo.append((outer, at[d > cut - reach]))


def forest(prints: np.ndarray, radius: int, view: int = 0, limit: int | None = None) -> list[tuple[int, int]]:
    """Spanning edges (by position) of the graph of pairs within the radius in one view
    and within the limit over all views (rows are texts, columns their views)."""
    parent = list(range(len(prints)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    searched = np.ascontiguousarray(prints[:, view])
    for at in range(0, len(prints), 256):
        rows = searched[at : at + 256, None]
        i, j = np.nonzero(np.bitwise_count(rows ^ searched[None, at:]) <= radius)
        keep = i < j
        i, j = i[keep] + at, j[keep] + at
        if limit is not None:
            close = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= limit
            i, j = i[close], j[close]
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(x), find(y)
            if p != q:
                parent[p] = q
                edges.append((x, y))
    return edges


def links(nodes: DataFrame, radius: int, columns: list[str], limit: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all linked pairs.
    ``nodes`` has a distinct row (node, views) per different fingerprint."""
    spark = nodes.sparkSession
    nodes = materialised(nodes.select("node", *columns))
    total = nodes.count()
    # the smallest of a second hash: a sample that is the same on every run
    sampled = nodes if total <= SAMPLE else nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE)
    rows = sampled.select(*columns).collect()
    masks = bit_blocks(radius)
    leaf = max(4, LEAF * len(rows) // max(total, 1))
    samples = [np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in columns]
    # one tree per view and block, each of at most a few nodes per sampled row
    trees = spark.sparkContext.broadcast([(v, m, grow(x, m, 1, leaf)) for v, x in enumerate(samples) for m in masks])
    names = ["tree", "leaf", "node", *columns]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            values = [part.column(c).to_numpy().view(np.uint64) for c in columns]
            for number, (view, mask, tree) in enumerate(trees.value):
                found = list(route(values[view], tree, mask, 1))
                if not found:
                    continue
                leaves = np.repeat(np.array([leaf_no for leaf_no, _ in found], np.int32), [len(where) for _, where in found])
                taken = pa.array(np.concatenate([where for _, where in found]))
                place = [pa.array(np.full(len(leaves), number, np.int32)), pa.array(leaves)]
                yield pa.RecordBatch.from_arrays([*place, *(part.column(c).take(taken) for c in ("node", *columns))], names)

    longs = ", ".join(f"`{c}` long" for c in ("node", *columns))
    routed = materialised(nodes.mapInArrow(deal, f"tree int, leaf int, {longs}"))
    full = routed.groupBy("tree", "leaf").count().filter(F.col("count") > MOST)
    full = full.select("tree", "leaf", F.ceil(F.col("count") / (MOST // 2)).cast("int").alias("parts"))
    placed = routed.join(full, ["tree", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("tree", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", *columns)

    def search(table: pa.Table) -> pa.Table:
        prints = np.stack([table.column(c).to_numpy() for c in columns], axis=1).view(np.uint64)
        found = forest(prints, radius, table.column("tree")[0].as_py() // len(masks), limit)
        i, j = (np.array([e[k] for e in found], np.int64) for k in (0, 1))
        named = table.column("node").to_numpy()
        return pa.table({"a": named[i], "b": named[j]})

    return placed.groupBy("tree", "leaf", "i", "j").applyInArrow(search, "a long, b long").distinct()


def components(prints: DataFrame, radius: int = 3, id_col: str = "doc_id", column: str = "fp", views: int = 1, limit: int | None = None) -> DataFrame:
    """``prints`` (id and fingerprints) with component_id, the smallest id reachable."""
    columns = view_columns(column, views)
    node = F.col(column) if views == 1 else F.xxhash64(*columns)
    least = prints.groupBy(*columns).agg(F.min(id_col).alias("least")).withColumn("node", node)
    least = materialised(least)
    roots = connected_components(links(least, radius, columns, limit))
    placed = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialised(placed.join(smallest, "root").select(*columns, "component_id"))
    return prints.join(named, columns)


def near_duplicates(df: DataFrame, words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of ``df``."""
    slim = df.select(F.col(id_col), F.col(text_col).alias("text"))
    prints = materialised(with_fingerprint(slim, "text", words).select(id_col, "fp"))
    return components(prints, radius, id_col)


def hex_digits(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
