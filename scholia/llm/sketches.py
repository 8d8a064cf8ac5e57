"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into passages (lines, and within them sentences; very long ones into
pieces of PIECE bytes).  Each passage, with the number of its earlier equals, has
a 64-bit digest, and a digest is added to three cells of the sketch: a count, the
sum of digests and the sum of their check hashes.  The sketch of one version minus
that of another holds only the digests in which they differ; cells with a single
digest are peeled, one after the other, until nothing is left.  If peeling gets
stuck the sketches are built again with four times as many cells.

The fingerprint is the sketch of CELLS cells with the number of passages, in
base64.  Likeness is the Jaccard index of the passage sets, from the peeled count; it is
read off two fingerprints alone wherever their difference peels (``compare``), and only
where it does not, texts are asked for larger sketches.

Edge cases: null and empty texts have no passage and the same fingerprint, and are
wholly alike (1.0); repeated passages count each time; ties in doc_id are ordered
by a hash of the text, null ids come last; a single document is its own successor;
an empty table gives none; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Cells of a fingerprint, hashes of a digest, bytes of a piece, growth on failure.
CELLS, HASHES, PIECE, GROWTH = 24, 3, 300, 4

#: Text bytes handled at once inside a task.
BLOCK = 1_000_000

_PASSAGE = re.compile(rb"[^.!?\n]{1,%d}[.!?\n]*|[.!?\n]+" % PIECE)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys, 9).astype(np.uint32)


def digests(text: str) -> np.ndarray:
    """One digest per passage; the n-th equal passage has a digest of its own."""
    import xxhash

    seen: dict[bytes, int] = {}
    out = []
    for passage in _PASSAGE.findall(text.encode()):
        n = seen.get(passage, 0)
        seen[passage] = n + 1
        out.append(xxhash.xxh64_intdigest(passage, n))
    return np.array(out, np.uint64)


class Sketches:
    """Sketches of many texts with the same number of cells."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray, texts: int, cells: int):
        self.cells, shape = cells, texts * cells
        self.count, self.keys, self.checks = np.zeros(shape, np.int64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint32)
        self.add(keys, owner, np.ones(len(keys), np.int64))

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        check, width = _check(keys), self.cells // HASHES
        up = sign.astype(np.uint64)  # -1 wraps around, as the sums do
        for j in range(HASHES):
            at = owner * self.cells + j * width + (_mix(keys, j + 1) % np.uint64(width)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, keys * up)
            np.add.at(self.checks, at, check * up.astype(np.uint32))

    def packed(self, number: int) -> bytes:
        part = slice(number * self.cells, (number + 1) * self.cells)
        return self.count[part].astype("<u4").tobytes() + self.keys[part].astype("<u8").tobytes() + self.checks[part].astype("<u4").tobytes()

    @classmethod
    def unpacked(cls, packed: list[bytes], cells: int) -> Sketches:
        out = object.__new__(cls)
        out.cells = cells
        rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), cells * 16)
        part = lambda a, b, kind: np.ascontiguousarray(rows[:, cells * a : cells * b]).view(kind).ravel()
        out.count, out.keys, out.checks = part(0, 4, "<u4").astype(np.int64), part(4, 12, "<u8").astype(np.uint64), part(12, 16, "<u4").astype(np.uint32)
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = object.__new__(Sketches)
        out.cells = self.cells
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests recovered for each text, and whether its sketch came out empty."""
        found = np.zeros(texts, np.int64)
        live = np.arange(texts)  # texts of which the last round took something
        offsets = np.arange(self.cells)
        while len(live):
            cell = (live[:, None] * self.cells + offsets).ravel()
            cell = cell[np.abs(self.count[cell]) == 1]
            sign = self.count[cell]
            keys = self.keys[cell] * sign.astype(np.uint64)
            pure = self.checks[cell] * sign.astype(np.uint32) == _check(keys)
            cell, sign, keys = cell[pure], sign[pure], keys[pure]
            owner = cell // self.cells
            order = np.lexsort((keys, owner))
            owner, sign, keys = owner[order], sign[order], keys[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]) if len(owner) else np.zeros(0, bool)
            owner, sign, keys = owner[new], sign[new], keys[new]
            self.add(keys, owner, -sign)
            found += np.bincount(owner, minlength=texts)
            live = np.unique(owner)
        rows = lambda x: x.reshape(texts, self.cells)
        return found, ~(rows(self.count).any(axis=1) | rows(self.keys).any(axis=1))


def _jaccard(na: np.ndarray, nb: np.ndarray, differing: np.ndarray) -> np.ndarray:
    return np.where(na + nb > 0, (na + nb - differing) / np.maximum(1, na + nb + differing), 1.0)


def compare(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Likeness of each pair of stored fingerprints, and whether it could be read off them:
    one sketch is subtracted from the other, and the rest peeled."""
    if not a:
        return np.zeros(0), np.zeros(0, bool)
    sizes, sides = [], []
    for prints in (a, b):
        split = [p.split(".", 1) for p in prints]
        sizes.append(np.array([int(n, 16) for n, _ in split], np.int64))
        sides.append(Sketches.unpacked([base64.b64decode(x) for _, x in split], CELLS))
    differing, whole = sides[0].minus(sides[1]).peel(len(a))
    return _jaccard(*sizes, differing), whole


def likeness(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Jaccard index of each pair of digest sets, by sketches of ``cells`` cells on."""
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    differing = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    while len(todo):
        # a sketch cannot give back more digests than it has cells
        ready = todo[np.abs(na - nb)[todo] <= cells]
        if len(ready):
            sides = []
            for side, n in ((a, na), (b, nb)):
                owner = np.repeat(np.arange(len(ready)), n[ready])
                keys = np.concatenate([side[i] for i in ready.tolist()])
                sides.append(Sketches(keys, owner, len(ready), cells))
            found, whole = sides[0].minus(sides[1]).peel(len(ready))
            differing[ready[whole]] = found[whole]
            todo = np.setdiff1d(todo, ready[whole])
        cells *= GROWTH
    return _jaccard(na, nb, differing)


def settled(prints: tuple[list[str], list[str]], sets: tuple[list[np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """Likeness of each pair of fingerprints; of the texts' larger sketches where they fail."""
    out, whole = compare(*prints)
    again = np.flatnonzero(~whole).tolist()
    if again:
        out[again] = likeness(*([side[i] for i in again] for side in sets), cells=CELLS * GROWTH)
    return out


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sketch = Sketches(np.concatenate([*sets, np.zeros(0, np.uint64)]), owner, len(sets), CELLS)
    return [f"{len(s):x}." + base64.b64encode(sketch.packed(i)).decode() for i, s in enumerate(sets)]


def with_successor(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, guest, id, text) dealt out and sorted so that a row's successor in
    descending id order is the row after it; the last row of a bucket is followed by a
    guest, a copy of the next bucket's first row.

    One shuffle of the texts; the buckets' edges come from approximate quantiles of
    the ids alone, and one row per bucket is copied.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    n = 4 * parts
    edges = sorted(set(docs.select(F.col("id").cast("double").alias("id")).stat.approxQuantile("id", [i / n for i in range(1, n)], 1 / (2 * n)))) if n > 1 else []
    # bucket 0 holds the largest ids; null ids come after all, dealt by their texts' hashes
    below = F.array(*(F.lit(e) for e in edges)) if edges else F.array().cast("array<double>")
    share = F.least(F.lit(n - 1), F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * n))
    bucket = F.when(F.col("id").isNull(), len(edges) + 1 + share).otherwise(F.size(F.filter(below, lambda e: e > F.col("id"))))
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket.cast("int"))
    order = [F.desc_nulls_last("id"), F.col("h"), F.col("text")]
    heads = docs.groupBy("bucket").agg(F.min(F.struct((-F.col("id")).alias("i"), "h")).alias("head"))  # one row per bucket
    ring = Window.orderBy("bucket")
    following = heads.select(
        F.col("bucket").alias("host"), F.coalesce(F.lead("bucket").over(ring), F.first("bucket").over(ring)).alias("bucket"),
    ).join(heads, "bucket")
    guests = docs.join(F.broadcast(following), "bucket").filter((-F.col("id")).eqNullSafe(F.col("head.i")) & (F.col("h") == F.col("head.h")))
    rows = docs.select("bucket", F.lit(False).alias("guest"), "id", "text", "h").union(guests.select(F.col("host"), F.lit(True), "id", "text", "h"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", *order).drop("h")


def compare_with_edit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row n_chars, the digest of its edited text, both fingerprints and their
    likeness, and the likeness to the next document's.

    The edit puts the first code points of the next document, as many as there are,
    in place of the last half of the text.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def results(pairs: list[tuple[int, str, str]]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for _, t, u in pairs]
        # a row's successor is mostly the next row: digest each text once
        known: dict[str, np.ndarray] = {}
        for _, t, u in pairs:
            for x in (t, u):
                if x not in known:
                    known[x] = digests(x)
        printed = dict(zip(known, fingerprints(list(known.values()))))
        own, after = ([known[p[k]] for p in pairs] for k in (1, 2))
        own_print, after_print = ([printed[p[k]] for p in pairs] for k in (1, 2))
        changed = [digests(t) for t in edited]
        changed_print = fingerprints(changed)
        columns = [
            pa.array([i for i, _, _ in pairs], pa.int64()),
            pa.array([len(t) for _, t, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(own_print),
            pa.array(changed_print),
            pa.array(settled((own_print, changed_print), (own, changed))),
            pa.array(settled((own_print, after_print), (own, after))),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pairs, size = None, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for row in zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "id", "text"))):
                    if last is not None and last[0] == row[0] and not last[1]:
                        pairs.append((last[2], last[3], row[3]))
                        size += len(last[3])
                    last = row
                    if size > BLOCK:
                        yield results(pairs)
                        pairs, size = [], 0
        if pairs:
            yield results(pairs)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(df, id_col, text_col).mapInArrow(run, schema)
