"""Quality scores from learned subword embeddings.

Every word and every character n-gram of a word (its edges marked) is hashed to a bucket;
a bucket has a learned vector.  A word equal to the one before it has the bucket of such
repeats instead, and every text one bucket for its end.  The vectors of a document are averaged, and a softmax layer
over the average gives the probability of each label.  Vectors and layer are trained
together in numpy by stochastic gradient descent over small batches, with a step size per
coordinate that shrinks with the gradients it has seen.

The model is fitted on a bounded sample: PER_LABEL training rows of each label, those with
the smallest hash of their id; the rows of a label weigh as much as it has among all
labelled training rows.  Every document is read whole, in training and in scoring.

Words are runs between white space (the six ASCII characters).  Texts are read in blocks of
BLOCK characters that end behind the last white space in them, or after BLOCK characters
if there is none; what a block has is added up, so memory does not grow with a text.

Edge cases: null and empty texts have the bucket of their end alone; null
labels teach nothing; of several labels of an id the highest counts, of several texts the
smallest is learned from; null ids are scored, never learned from; repeated rows score alike; with labels of one kind only, all scores
are that label's share, 0 or 1; without labels all are 0.5; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks, materialised, text_or_empty

#: Bounds of the sample and of the model.
PER_LABEL, BUCKETS, DIM = 2000, 1 << 16, 8

#: Lengths of character n-grams, edges included.
GRAMS = (2, 3)

#: Buckets of a word that repeats the one before it, and of a text's end; hashes may meet them.
AGAIN, END = 0, 1

#: Characters of a long text that are read together.
BLOCK = 1 << 20

_SPACES = np.zeros(33, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _bucket(h: np.ndarray, length: int) -> np.ndarray:
    h = (h + np.uint64(length)) * _MIX
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def buckets_of(text: str) -> np.ndarray:
    """Buckets of the words and character n-grams of a text, repeats included."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACES[np.minimum(codes, 32)] & (codes < 33)
    edged = np.concatenate([[True], space, [True]])
    starts = np.flatnonzero(edged[:-1] & ~edged[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.int64)
    h = np.concatenate([[0], np.where(space, 0, codes), [0]]).astype(np.uint64)  # 0 marks an edge
    sizes = np.flatnonzero(~edged[:-1] & edged[1:]) + 1 - starts
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    words = np.add.reduceat(h[~edged] * _powers(int(sizes.max()))[place], firsts)
    again = np.concatenate([[False], words[1:] == words[:-1]])
    found = [np.full(int(again.sum()), AGAIN), _bucket(words[~again], 0)]
    # of a word that repeats the one before it, only that counts
    fresh = ~again[np.maximum(np.cumsum(edged[:-1] & ~edged[1:]) - 1, 0)]
    for n in GRAMS:
        rolled = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            rolled = rolled * _STEP + h[k : len(h) - n + 1 + k]
        inner = edged[: len(rolled)] & edged[n - 1 :]
        inner = inner if n == 2 else np.zeros_like(inner)
        for k in range(1, n - 1):
            inner |= edged[k : len(h) - n + 1 + k]
        found.append(_bucket(rolled[~inner & fresh[: len(rolled)]], n))
    return np.concatenate(found)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _STEP * np.uint64(2) + np.uint64(1))]), dtype=np.uint64)


def blocks_of(text: str) -> Iterator[str]:
    """A text in blocks of at most BLOCK characters, words kept whole where they fit."""
    start = 0
    while len(text) - start > BLOCK:
        cut = max(text.rfind(c, start, start + BLOCK) for c in " \t\n\x0b\x0c\r")
        stop = cut + 1 if cut >= start else start + BLOCK
        yield text[start:stop]
        start = stop
    yield text[start:]


@dataclass(frozen=True)
class QualityModel:
    """``gain``: what a bucket adds to the log odds of label 1; ``bias``: the log odds of none."""

    gain: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        total, n = float(self.gain[END]), 1
        for block in blocks_of(text):
            found = buckets_of(block)
            total, n = total + float(self.gain[found].sum(dtype=np.float64)), n + len(found)
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / n, -60, 60))))


def train(docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 1.0, seed: int = 7) -> QualityModel:
    """Vectors and softmax layer from documents (buckets, their shares), labels 0 / 1 and weights."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    seen_v, seen_l, seen_b = np.full((BUCKETS, DIM), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(docs))
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            at = np.concatenate([docs[i][0] for i in some])
            share = np.concatenate([docs[i][1] for i in some])[:, None]
            sizes = np.array([len(docs[i][0]) for i in some])
            mean = np.add.reduceat(vectors[at] * share, np.cumsum(sizes) - sizes)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), label[some]] -= 1
            slope = p * (weight[some] / len(some))[:, None]
            down = np.repeat(slope @ layer.T, sizes, axis=0) * share
            by = np.argsort(at, kind="stable")
            firsts = np.flatnonzero(np.diff(at[by], prepend=-1))
            touched, grad = at[by][firsts], np.add.reduceat(down[by], firsts)
            seen_v[touched] += grad**2
            vectors[touched] -= step * grad / np.sqrt(seen_v[touched])
            for value, seen, grad in ((layer, seen_l, mean.T @ slope), (bias, seen_b, slope.sum(axis=0))):
                seen += grad**2
                value -= step * grad / np.sqrt(seen)
    return QualityModel(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fit(df: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> QualityModel:
    """Fit on the labelled rows of ``df`` for which ``trains`` (a condition on the id) holds."""
    known = labels.filter(trains & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) == 1).cast("int").alias("label")).filter("label is not null")
    good, n = known.agg(F.sum("label"), F.count("*")).first()
    if not n or good in (0, n):
        return QualityModel(np.zeros(BUCKETS, np.float32), 60.0 * (1 if n and good else -1 if n else 0))
    order = [F.xxhash64(F.col(id_col)), F.col(id_col)]
    pick = lambda x: known.filter(F.col("label") == x).orderBy(*order).limit(per_label)
    chosen = materialised(pick(0).union(pick(1)))  # 2 * per_label rows at most

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                counts = sum((np.bincount(buckets_of(b), minlength=BUCKETS) for b in blocks_of(text)), np.zeros(BUCKETS, np.int64))
                counts[END] += 1
                at = np.flatnonzero(counts)
                found.append((at.astype(np.int32), (counts[at] / counts.sum()).astype(np.float32)))
            lists = [pa.array([x[k] for x in found], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *lists], ["id", "label", "at", "share"])

    texts = df.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    sampled = texts.join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    kind = sampled.schema["id"].dataType.simpleString()
    table = sampled.mapInArrow(featurise, f"id {kind}, label int, at array<int>, share array<float>").toArrow()
    order = np.argsort(table.column("id").to_numpy(zero_copy_only=False), kind="stable")
    label = table.column("label").to_numpy()[order]
    if not len(label) or label.all() or not label.any():
        return QualityModel(np.zeros(BUCKETS, np.float32), 60.0 * (1 if good * 2 > n else -1))
    lists = [table.column(c).combine_chunks() for c in ("at", "share")]
    docs = [(lists[0][int(i)].values.to_numpy().astype(np.int64), lists[1][int(i)].values.to_numpy()) for i in order]
    weight = np.where(label == 1, good / n / label.mean(), (1 - good / n) / (1 - label.mean())).astype(np.float32)
    return train(docs, label, weight)


def score(df: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 in ``out``."""
    kept = [c for c in df.columns if c != out]
    hidden = "text" + "_" * (1 + max(map(len, kept), default=0))  # longer than any name it could clash with
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, hidden):
            scores = [shared.value.score(t) for t in batch.column(hidden).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, out])

    return df.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(F.col(f"`{text_col}`")).alias(hidden)).mapInArrow(run, schema)
