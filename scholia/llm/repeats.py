"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes of the UTF-8 texts are ordered through their first ``depth`` bytes and no
further, most significant digit first; suffixes that end up in one group are
exactly the repeated windows.  Three digits are used, and whatever is alone in
its group after a digit is dropped before the next:

1. the *anchor*: of all ``ANCHOR``-byte strings inside the window the one with the
   smallest hash, the leftmost of equals.  Equal windows have equal anchors at
   equal offsets, and neighbouring windows mostly share theirs, so suffixes enter
   the first pass as *units*: the run of windows that one anchor owns;
2. the whole *span* of a unit.  Units with equal spans consist of repeated windows
   through and through (exact copies and the inside of shared passages end here);
3. within an anchor's group, for one unit of each different span, the remaining
   bytes of every window in digits of DIGIT bytes down to ``depth``.

The first two passes are aggregations over hashes in Spark.  The third sorts the
anchors' groups in numpy, many groups at a time; groups of over MOST spans are sorted
by whole windows in Spark instead, where partial aggregation takes care of hot ones.

Edge cases: a null text is empty; texts shorter than ``depth`` have no window and
stay whole; equal texts of at least ``depth`` bytes vanish; rows with equal id and
equal text count as separate documents (each repeats the other); rows with equal
or null ids but different texts are told apart by a hash of the text; an empty
table gives none; other columns pass through where the caller keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks, materialised, text_or_empty

#: Bytes of a window, of an anchor, and of a digit of the third pass.
DEPTH, ANCHOR, DIGIT = 200, 50, 50

#: Spans of one anchor that a task sorts by itself, at most; bytes of groups sorted together.
MOST, GROUPS_BYTES = 2000, 2_000_000

#: Odd multipliers of the two rolling hashes, with their inverses modulo 2**64.
_A, _B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and step**-i for i up to n (modulo 2**64)."""
    have = _POWERS.get(step)
    if have is None or len(have[0]) <= n:
        size = 1 << max(20, n.bit_length())
        out = []
        for base in (step, pow(step, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[step] = out[0], out[1]
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substrings of one byte buffer."""

    def __init__(self, data: np.ndarray, step: int):
        power, self.inverse = _powers(step, len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        """Of the substring of that length at each place."""
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of every window of ``width`` values."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    # places are ranked with their values: ties go to the left
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    rows = padded.reshape(blocks, width)
    column = np.arange(width)
    low = np.minimum.accumulate(rows, axis=1)
    # leftmost place of the running minimum from the block's start
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] < low[:, :-1]
    from_start = np.maximum.accumulate(np.where(new, column, 0), axis=1)
    back = rows[:, ::-1]
    high = np.minimum.accumulate(back, axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = back[:, 1:] <= high[:, :-1]
    from_end = (width - 1 - np.maximum.accumulate(np.where(new, column, 0), axis=1))[:, ::-1]
    base = (np.arange(blocks) * width)[:, None]
    start_place, end_place = (from_start + base).ravel(), (from_end + base).ravel()
    i = np.arange(n)
    left, right = end_place[i], start_place[i + width - 1]
    return np.where(padded[left] <= padded[right], left, right)


def units_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, anchor hash, span hash) of all units."""
    anchor = max(1, min(ANCHOR, depth // 4))
    width = depth - anchor + 1
    long = [i for i, t in enumerate(texts) if len(t) >= depth]
    if not long:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    data = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    size = np.array([len(texts[i]) for i in long], np.int64)
    begin = np.cumsum(size) - size
    one, two = Rolling(data, _A), Rolling(data, _B)
    keys = one.every(anchor)
    chosen = _sliding_argmin(keys, width)
    # windows of this buffer that lie inside one text
    inside = np.ones(len(data) - depth + 1, bool)
    for e in (begin + size)[:-1].tolist():
        inside[max(0, e - depth + 1) : e] = False
    place = np.flatnonzero(inside)
    owner = chosen[place]
    breaks = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]))
    first, last = place[breaks], place[np.append(breaks[1:], len(place)) - 1]
    at = owner[breaks]
    number = np.searchsorted(begin, first, side="right") - 1
    span = two.of(first, last + depth)
    # the span hash also fixes where in the span the anchor stands
    span = _mix(span ^ _mix((at - first).astype(np.uint64) + np.uint64(0x9E37)) ^ (last - first).astype(np.uint64))
    return np.array(long, np.int64)[number], first - begin[number], last - begin[number], keys[at], span


def repeated_windows(buffer: np.ndarray, place: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which of the windows at ``place`` have an equal one in their group: digits of
    DIGIT bytes, most significant first, windows alone in their group dropped."""
    rolling = Rolling(buffer, _A)
    live = np.arange(len(place))
    for at in range(0, depth, DIGIT):
        if not len(live):
            break
        digit = rolling.of(place[live] + at, place[live] + min(at + DIGIT, depth))
        order = np.lexsort((digit, group[live]))
        live, digit, held = live[order], digit[order], group[live][order]
        new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (held[1:] != held[:-1])])
        number = np.cumsum(new) - 1
        group = group.copy()
        group[live] = number
        live = live[np.bincount(number)[number] > 1]
    out = np.zeros(len(place), bool)
    out[live] = True
    return out


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row's key: its id and its text's hash of 64 bits, which tells rows without id apart; and the text."""
    text = text_or_empty(F.col(f"`{text_col}`"))
    id_or_least = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    return df.withColumn("__id", id_or_least).withColumn("__th", F.xxhash64(text)).withColumn("__text", text)


def _compressed(df: DataFrame) -> DataFrame:
    """``__text`` as zstd bytes in ``__z``: texts are shuffled twice, at half the size."""
    kept = [c for c in df.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in in_chunks(batches, "__text"):
            packed = pa.array([pack(t.encode()) for t in batch.column("__text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), packed], [*kept, "__z"])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField("__z", T.BinaryType())]))


def repeated_spans(df: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __th, spans): for each row with a repeated window the byte ranges to cut,
    as flat [start, end, start, end, ...], sorted and apart."""
    docs = _keyed(df, id_col, text_col).select("__id", "__th", "__text")

    def make_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "__text", 1_000_000):
            number, first, last, key, span = units_of(batch.column("__text").cast(pa.binary()).to_pylist(), depth)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id").take(pa.array(number)),
                    batch.column("__th").take(pa.array(number)),
                    pa.array(first.astype(np.int32)),
                    pa.array((last - first).astype(np.int32)),
                    pa.array(key.view(np.int64)),
                    pa.array(span.view(np.int64)),
                ],
                ["__id", "__th", "first", "more", "key", "span"],
            )

    units = materialised(docs.mapInArrow(make_units, "__id long, __th long, first int, more int, key long, span long"))
    # pass 1: anchors that stand alone drop out
    groups = units.groupBy("key").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")).filter("n > 1")
    # written out, so that the join below shuffles both sides anew and can split a hot key
    groups = materialised(groups.select("key", (F.col("low") != F.col("high")).alias("mixed")))
    met = materialised(units.join(groups, "key"))
    # pass 2: equal spans are repeated; one unit of each span stays for pass 3
    mixed = met.filter("mixed")
    sample = F.struct("__id", "__th", "first", "more")
    spans = materialised(mixed.groupBy("key", "span").agg(F.count("*").alias("copies"), F.min(sample).alias("unit")))
    settled = met.filter(~F.col("mixed")).select("__id", "__th", "first", "more")
    # nothing but this join runs on the exchange, so a span with very many copies is split
    copied = materialised(mixed.join(spans.filter("copies > 1").select("key", "span"), ["key", "span"]).select("__id", "__th", "first", "more"))
    sizes = materialised(spans.groupBy("key").agg(F.count("*").alias("spans")))
    wanted = spans.join(sizes, "key").select("key", "span", "unit.*", "spans", (F.col("copies") == 1).alias("open"))
    listed = wanted.groupBy("__id", "__th").agg(F.collect_list(F.struct("key", "span", "first", "more", "spans", "open")).alias("units"))
    # the bytes of those units, or the hashes of all their windows where a group is large
    pieces = materialised(_one_of_equal(_compressed(docs), docs).join(listed, ["__id", "__th"]).select("__id", "__th", "__z", "units").mapInArrow(_pieces(depth), _PIECES))
    # an open unit is the only one of its span, so what is found for it needs no way back to others
    dealt = pieces.filter("window = -1").repartition("key").sortWithinPartitions("key", "span")
    small = dealt.mapInArrow(_sort_groups(depth), "__id long, __th long, first int")
    large = pieces.filter("window >= 0")
    again = large.groupBy("key", "hash").agg(F.min("span").alias("low"), F.max("span").alias("high")).filter("low <> high").select("key", "hash")
    # written out on both sides of the join, so that a very common window is split
    large = materialised(large.filter("open").join(materialised(again), ["key", "hash"]).select("__id", "__th", (F.col("first") + F.col("window")).alias("first")))
    found = small.unionByName(large).withColumn("more", F.lit(0))
    every = settled.unionByName(copied).unionByName(found)
    # first + more: windows; depth more bytes: what they cover; rows that are equal say it once
    return every.groupBy("__id", "__th").agg(F.collect_set(F.struct("first", "more")).alias("windows"))


def _one_of_equal(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with one row of those that share id and text: more would only repeat its pieces."""
    keys = ["__id", "__th"]
    again = materialised(docs.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys))
    if again.isEmpty():
        return rows
    return rows.join(again, keys, "left_anti").unionByName(rows.join(again, keys, "left_semi").dropDuplicates(keys))


_PIECES = "__id long, __th long, key long, span long, open boolean, first int, more int, bytes binary, window int, hash long"


def _pieces(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", "__th", "key", "span", "open", "first", "more", "bytes", "window", "hash"]
        kinds = [*[pa.int64()] * 4, pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in in_chunks(batches, "__z", 200_000):
            rows = []
            for i, th, packed, units in zip(*(batch.column(c).to_pylist() for c in ("__id", "__th", "__z", "units"))):
                data = unpack(packed)
                for u in units:
                    piece = data[u["first"] : u["first"] + u["more"] + depth]
                    if u["spans"] <= MOST:
                        rows.append((i, th, u["key"], u["span"], u["open"], u["first"], u["more"], piece, -1, 0))
                        continue
                    rolling = Rolling(np.frombuffer(piece, np.uint8), _B)
                    for w, h in enumerate(rolling.every(depth).view(np.int64).tolist()):
                        rows.append((i, th, u["key"], u["span"], u["open"], u["first"], 0, None, w, h))
            for at in range(0, len(rows), 50_000):
                columns = zip(*rows[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return run


def _sort_groups(depth: int):
    """Over rows ordered by key: whole groups, many at a time, sorted by their windows' digits."""

    def again(table: pa.Table) -> pa.RecordBatch:
        key, span = table.column("key").to_numpy(), table.column("span").to_numpy()
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (span[1:] != span[:-1])])
        table, key = table.take(pa.array(np.flatnonzero(new))), key[new]  # repeated rows share a unit
        pieces = table.column("bytes").combine_chunks()
        pieces = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        buffer = np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        begin = offsets[:-1] - offsets[0]
        many = table.column("more").to_numpy().astype(np.int64) + 1
        unit = np.repeat(np.arange(len(many)), many)
        start = np.arange(len(unit)) - np.repeat(np.cumsum(many) - many, many)
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        found = repeated_windows(buffer, begin[unit] + start, group[unit], depth)
        found &= table.column("open").to_numpy()[unit]
        taken = pa.array(unit[found])
        first = table.column("first").to_numpy()[unit[found]] + start[found]
        columns = [*(table.column(c).take(taken).combine_chunks() for c in ("__id", "__th")), pa.array(first, pa.int32())]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], ["__id", "__th", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < GROUPS_BYTES:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            whole = int(np.searchsorted(key == key[-1], True))  # the last group may go on
            if whole:
                yield again(table.slice(0, whole))
                rest = table.slice(whole).combine_chunks()
                held, size = rest.to_batches(), rest.nbytes
        if held:
            yield again(pa.Table.from_batches(held))

    return run


def cover(windows: list[dict], depth: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows first..first+more of ``depth`` bytes."""
    out: list[list[int]] = []
    for a, b in sorted((w["first"], w["first"] + w["more"] + depth) for w in windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the parts of UTF-8 characters that they cut through."""
    out = []
    for a, b in runs:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def cut_repeats(df: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
    """``df`` without its text, with spans (array of struct start, end: the byte runs
    removed), n_bytes (before) and kept_bytes (binary: the rest).  ``characters``
    leaves characters whole that a run cuts through."""
    kept = [c for c in df.columns if c not in (text_col, "spans", "n_bytes", "kept_bytes")]
    spans = repeated_spans(df, depth, id_col, text_col)
    keyed = _compressed(_keyed(df, id_col, text_col).select(*(F.col(f"`{c}`") for c in kept), "__id", "__th", "__text"))
    joined = keyed.join(spans, ["__id", "__th"], "left")
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("spans", span_type), T.StructField("n_bytes", T.LongType()), T.StructField("kept_bytes", T.BinaryType())])
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in in_chunks(batches, "__z"):
            spans, rest, size = [], [], []
            for packed, windows in zip(batch.column("__z").to_pylist(), batch.column("windows").to_pylist()):
                data = unpack(packed)
                size.append(len(data))
                runs = cover(windows or [], depth)
                runs = whole_characters(data, runs) if characters else runs
                spans.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(data)]
                rest.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(spans, arrow_span), pa.array(size, pa.int64()), pa.array(rest, pa.binary())], [*kept, "spans", "n_bytes", "kept_bytes"])

    return joined.select(*(F.col(f"`{c}`") for c in kept), "__z", "windows").mapInArrow(run, schema)
