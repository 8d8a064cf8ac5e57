"""Language-model scores from a log-frequency Bloom filter.

Counts of word unigrams and bigrams over the whole training part are quantised
to levels (a level is a factor of BASE); an n-gram of level q enters the filter
once for each level up to q, so its level is read back by probing 1, 2, ...
until a probe misses.  Every n-gram enters, those seen once with level 1.  Scores
interpolate the bigram estimate with a smoothed unigram one, both from such
quantised counts.

The filter grows with the corpus, so it is never broadcast: it is cut into segments by
ranges of n-gram hashes, and the questions travel instead.  Texts are read once and become
*chunks* of about CHUNK_TOKENS tokens, held as numbers of the chunk's own vocabulary.  A
chunk sends each range one sorted run of its distinct n-grams with their counts in the
training part.  The task of a range adds the counts up, builds the segment, probes it
once for each distinct n-gram and answers every run in the run's order.  Last, each chunk
meets its answers and its texts are scored.  Ranges hold about RANGE_TOKENS n-grams
however large the corpus, and nothing but the sums N and V passes the driver.

The range's task knows exact counts too.  Those of unigrams travel with the answers and
give the exact base score beside the model's.  N-grams are told apart by 64-bit hashes.

Edge cases: null texts are empty (one end token); rows where ``held_out`` is null are
learned from; without any training row N and V are 0 and the base score of a token is
log10(0.1 / 0.1); repeated rows count each time and score alike; a very long text is a
chunk of its own; an empty table gives none; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks, materialised, text_or_empty

#: Tokens of a chunk, n-gram tokens to a range of hashes.
CHUNK_TOKENS, RANGE_TOKENS = 1_000_000, 1_500_000

#: Factor between levels; bits per entry and probes of the filter.
BASE, BITS, PROBES = 2.0, 10, 5

#: Weight of the bigram estimate, added count of the unigram one.
BIGRAM_WEIGHT, ADDED = 0.4, 0.1

_END = 0x5851F42D4C957F2D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tokens_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, without the end token."""
    return text.encode().lower().split()


def level(counts: np.ndarray) -> np.ndarray:
    """The level of a count; 0 for a count of 0."""
    levels = 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)
    return np.where(counts > 0, levels, 0)


def estimate(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for level 0."""
    low = BASE ** (levels - 1.0)
    return np.where(levels > 0, (low + np.maximum(low, BASE * low - 1)) / 2, 0.0)


def _bit_places(keys: np.ndarray, at_level: np.ndarray, n_bits: int) -> Iterator[np.ndarray]:
    h = _mix(keys ^ (np.asarray(at_level).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    step = _mix(h) | np.uint64(1)
    high, n = np.uint64(32), np.uint64(n_bits)
    for i in range(PROBES):  # the upper half of the hash, scaled to the segment
        yield (((h + np.uint64(i) * step) >> high) * n >> high).astype(np.int64)


class Segment:
    """The filter over one range of n-grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits_each: int = BITS):
        levels = level(counts)
        keys, levels = keys[levels > 0], levels[levels > 0]
        self.n_bits = max(64, -(-int(levels.sum()) * bits_each // 8) * 8)
        bits = np.zeros(self.n_bits, bool)
        while len(keys):
            for place in _bit_places(keys, levels, self.n_bits):
                bits[place] = True
            levels = levels - 1
            keys, levels = keys[levels > 0], levels[levels > 0]
        self.bits = np.packbits(bits, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 where the filter does not hold it."""
        out, live, probed = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(live):
            probed += 1
            asked, hit = keys[live], np.arange(len(live))  # those that have hit so far
            for place in _bit_places(asked, np.int64(probed), self.n_bits):
                place = place[hit]
                hit = hit[(self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
            live = live[hit]
            out[live] = probed
        return out


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), kind)


def _planes(x: np.ndarray) -> bytes:
    """Byte planes apart, so that they compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(raw: np.ndarray, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return raw.reshape(size, -1).T.copy().view(kind).ravel()


class Chunk:
    """Tokens of some texts as numbers of a vocabulary of their own; number 0 is the end."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, sizes: np.ndarray):
        self.vocabulary, self.tokens, self.sizes = vocabulary, tokens.astype(np.int64), sizes
        self.starts = np.cumsum(sizes) - sizes
        self.inner = np.ones(len(tokens), bool)  # tokens with another before them in their text
        self.inner[self.starts] = False

    def packed(self) -> tuple[bytes, bytes]:
        return _zip(self.vocabulary.tobytes()), _zip(_planes(self.tokens.astype("<u4")))

    @classmethod
    def unpacked(cls, vocabulary: bytes, tokens: bytes, sizes: np.ndarray) -> Chunk:
        return cls(_unzip(vocabulary, "<u8"), _from_planes(_unzip(tokens, "u1"), "<u4"), sizes)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, pair, order): a key for each word of the vocabulary and each different
        pair; for each inner token the number of its pair; what sorts the keys.  The
        lowest bit of a key tells pairs from words."""
        one, size = np.uint64(1), np.int64(len(self.vocabulary))
        at = np.flatnonzero(self.inner)
        different, pair = np.unique(self.tokens[at - 1] * size + self.tokens[at], return_inverse=True)
        before, word = (self.vocabulary[x] for x in (different // size, different % size))
        pairs = _mix(_mix(before) + word * np.uint64(0x9E3779B97F4A7C15)) | one
        keys = np.concatenate([_mix(self.vocabulary) & ~one, pairs])
        return keys, pair, np.argsort(keys)

    def counts(self, pair: np.ndarray, learned: np.ndarray, n: int) -> np.ndarray:
        """Of the keys, in the texts that are learned from."""
        words = len(self.vocabulary)
        of_text = np.repeat(learned, self.sizes)
        return np.concatenate(
            [
                np.bincount(self.tokens[of_text], minlength=words),
                np.bincount(pair[of_text[self.inner]], minlength=n - words),
            ]
        )


def chunks(df: DataFrame, held_out: Column, text_col: str = "text") -> DataFrame:
    """(chunk, vocabulary, tokens, sizes, learned, rows): ``rows`` are the columns of
    ``df`` without the text."""
    kept = [c for c in df.columns if c != text_col]
    row = T.StructType([df.schema[c] for c in kept])
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("vocabulary", T.BinaryType()),
            T.StructField("tokens", T.BinaryType()),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("learned", T.ArrayType(T.BooleanType())),
            T.StructField("rows", T.ArrayType(row)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        digest, part = xxhash.xxh64_intdigest, TaskContext.get().partitionId()
        number: dict[bytes, int] = {}
        hashes, tokens, sizes, learned, rows, done = [_END], [], [], [], [], 0

        def made() -> pa.RecordBatch:
            whole = pa.concat_arrays(rows)
            packed = Chunk(np.array(hashes, np.uint64), np.concatenate(tokens), np.array(sizes)).packed()
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [pa.array([(part << 32) + done], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)]
            columns += [one(pa.array(sizes, pa.int64())), one(pa.array(np.concatenate(learned))), one(whole)]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in in_chunks(batches, "__text"):
            split = [tokens_of(t) for t in batch.column("__text").to_pylist()]
            for words in split:
                for word in set(words):
                    if word not in number:
                        number[word] = len(hashes)
                        hashes.append(digest(word))
                words = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
                tokens.append(np.append(words, np.uint32(0)))
                sizes.append(len(words) + 1)
            learned.append(batch.column("__learned").to_numpy(zero_copy_only=False))
            rows.append(pa.StructArray.from_arrays([batch.column(c) for c in kept], kept))
            if sum(sizes) >= CHUNK_TOKENS:
                yield made()
                number, hashes, tokens, sizes, learned, rows, done = {}, [_END], [], [], [], [], done + 1
        if sizes:
            yield made()

    learned = (~F.coalesce(held_out, F.lit(False))).alias("__learned")
    return df.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(F.col(f"`{text_col}`")).alias("__text"), learned).mapInArrow(run, schema)


def _unpacked(row: dict) -> Chunk:
    return Chunk.unpacked(row["vocabulary"], row["tokens"], np.array(row["sizes"], np.int64))


def runs_of(parts: DataFrame, ranges: int) -> DataFrame:
    """(range, chunk, run): the sorted n-grams of each chunk, as differences, and their counts."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = _unpacked(row)
                keys, pair, order = part.grams()
                counts = part.counts(pair, np.array(row["learned"], bool), len(keys))[order].astype("<u4")
                keys = keys[order]
                cut = np.searchsorted(keys >> shift if ranges > 1 else np.zeros(len(keys), np.uint64), np.arange(ranges + 1).astype(np.uint64))
                full = np.flatnonzero(cut[1:] > cut[:-1])
                packed = [_zip(_planes(np.diff(keys[a:b], prepend=np.uint64(0))) + _planes(counts[a:b])) for a, b in zip(cut[full].tolist(), cut[full + 1].tolist())]
                columns = [pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["range", "chunk", "run"])

    return parts.select("chunk", "vocabulary", "tokens", "sizes", "learned").mapInArrow(run, "range int, chunk long, run binary")


def answers_to(bits_each: int):
    """The runs of one range: their n-grams' levels and the words' exact counts, in the
    order of each run; n_tokens and n_types of the range stand in the first row."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for blob in table.column("run").to_pylist():
            raw = _unzip(blob, "u1")
            n = len(raw) // 12
            keys.append(np.cumsum(_from_planes(raw[: 8 * n], "<u8"), dtype=np.uint64))
            counts.append(_from_planes(raw[8 * n :], "<u4"))
        cut = np.cumsum([len(k) for k in keys])[:-1]
        flat = np.concatenate(keys)
        different, place = np.unique(flat, return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(different)).astype(np.int64)
        levels = Segment(different, total, bits_each).levels(different)
        word = different & np.uint64(1) == 0
        packed = []
        for k, at in zip(keys, np.split(place, cut)):
            packed.append(_zip(levels[at].tobytes() + _planes(total[at[k & np.uint64(1) == 0]])))
        rest = [0] * (len(packed) - 1)
        return pa.table(
            {
                "range": table.column("range"),
                "chunk": table.column("chunk"),
                "n": pa.array([len(k) for k in keys], pa.int32()),
                "answer": pa.array(packed, pa.binary()),
                "n_tokens": pa.array([int(total[word].sum()), *rest], pa.int64()),
                "n_types": pa.array([int((total[word] > 0).sum()), *rest], pa.int64()),
            }
        )

    return run


def log_probabilities(part: Chunk, pair: np.ndarray, levels: np.ndarray, n_tokens: int, n_types: int) -> np.ndarray:
    """log10 of the model's probability of each token; ``levels`` of all keys."""
    words = len(part.vocabulary)
    count = estimate(levels[:words].astype(np.int64))[part.tokens]
    p = (count + ADDED) / (n_tokens + ADDED * (n_types + 1))
    at = np.flatnonzero(part.inner)
    context = count[at - 1]
    known = context > 0
    at = at[known]
    ratio = np.minimum(1.0, estimate(levels[words:].astype(np.int64))[pair[known]] / context[known])
    p[at] = BIGRAM_WEIGHT * ratio + (1 - BIGRAM_WEIGHT) * p[at]
    return np.log10(np.minimum(p, 1.0))


def score(df: DataFrame, held_out: Column, text_col: str = "text", bits_each: int = BITS) -> DataFrame:
    """``df`` (without its text) with n_tokens, n_known, train_tokens, base_score and
    score; rows where ``held_out`` is true are not learned from."""
    out = ["n_tokens", "n_known", "base_score", "score"]
    rows = df.drop(*(c for c in (*out, "train_tokens") if c != text_col))
    parts = materialised(chunks(rows, held_out, text_col))
    tokens = parts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    ranges = 1 << max(0, int(np.ceil(np.log2(max(1, 2 * tokens / RANGE_TOKENS)))))
    answers = runs_of(parts, ranges).groupBy("range").applyInArrow(answers_to(bits_each), "range int, chunk long, n int, answer binary, n_tokens long, n_types long")
    answers = materialised(answers)
    n_tokens, n_types = (x or 0 for x in answers.agg(F.sum("n_tokens"), F.sum("n_types")).first())
    row = parts.schema["rows"].dataType.elementType
    fields = [*row.fields, T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bottom = np.log10(n_tokens + ADDED * (n_types + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                got = batch.slice(i, 1)
                part = _unpacked(got.select(["vocabulary", "tokens", "sizes"]).to_pylist()[0])
                keys, pair, order = part.grams()
                levels, exact, at, words = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.int64), 0, len(part.vocabulary)
                for a in sorted(got.column("answers").to_pylist()[0], key=lambda a: a["range"]):
                    raw, where = _unzip(a["answer"], "u1"), order[at : at + a["n"]]
                    levels[where] = raw[: a["n"]]
                    exact[where[where < words]] = _from_planes(raw[a["n"] :], "<i8")
                    at += a["n"]
                logs = log_probabilities(part, pair, levels, n_tokens, n_types)
                single = (np.log10(exact[:words] + ADDED) - bottom)[part.tokens]
                known = (exact[:words] > 0)[part.tokens]
                sums = [pa.array(part.sizes), *(pa.array(np.add.reduceat(x, part.starts)) for x in (known.astype(np.int64), single, logs))]
                held = got.column("rows").flatten()
                yield pa.RecordBatch.from_arrays([*held.flatten(), *sums], [f.name for f in fields])

    told = answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "n", "answer")).alias("answers"))
    met = parts.select("chunk", "vocabulary", "tokens", "sizes", "rows").join(told, "chunk").select("vocabulary", "tokens", "sizes", "rows", "answers")
    return met.mapInArrow(scored, T.StructType(fields)).withColumn("train_tokens", F.lit(n_tokens).cast("long"))
