"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other training text counts as
unlabelled.  A logistic model over word and word-prefix features is fitted in
numpy by the class-prior-corrected risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

whose second part is kept from going negative (its gradient is reversed there).
The prior is the share of toxic rows among the labelled training rows.

The model is fitted on a bounded sample: POSITIVES toxic and UNLABELLED other
training rows, those with the smallest hash of their id, and keeps the FEATURES
features that tell the two apart best.  Every document is scored over its whole
text.

Edge cases: null and empty texts get the score of a text without features; null
or repeated labels count once, the highest label of an id; rows with a null id
are scored but never learned from; repeated rows score alike; without a toxic
training row all scores are 0; an empty table gives none; only id and text are
read, so further columns never clash.
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

#: Bounds of the sample that the model is fitted on, and of its features.
POSITIVES, UNLABELLED, FEATURES = 3000, 6000, 1500

#: Beginnings of words, in characters, that are features beside the word itself.
PREFIXES = (4, 5, 6, 7)

#: Cached words in a Python worker; beyond it the cache starts anew.
CACHE_WORDS = 400_000

_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”‘’„¡¿…–—"


def word_features(word: str) -> list[str]:
    word = word.lower().strip(_EDGES)
    if not word:
        return []
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


@dataclass(frozen=True)
class ToxicityModel:
    index: dict[str, int]
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: list[str], cache: dict[str, tuple]) -> np.ndarray:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out = np.empty(len(texts))
        index, weights = self.index, self.weights
        for i, text in enumerate(texts):
            words = set(text.split())
            for word in words:
                if word not in cache:
                    cache[word] = tuple(index[f] for f in word_features(word) if f in index)
            found = set().union(*filter(None, map(cache.__getitem__, words)))
            out[i] = self.bias + (weights[list(found)].sum() if found else 0.0)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 250, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative PU risk, by Adam on full batches."""
    p, u = x[positive], x[~positive]
    w, b = np.zeros(x.shape[1] + 1), 0.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, uu = sigmoid(zp), sigmoid(zu)
        grad_neg_p, grad_neg_u = -prior * up / len(p), uu / len(u)
        if negative >= 0:
            gp, gu = prior * (up - 1) / len(p) + grad_neg_p, grad_neg_u
        else:
            gp, gu = -grad_neg_p, -grad_neg_u
        grad = np.append(gp @ p + gu @ u + ridge * w[:-1], gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(df: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the rows of ``df`` for which ``trains`` (a condition on the id) holds."""
    known = labels.filter(trains & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic")).filter("toxic is not null")
    toxic, n = known.agg(F.sum("toxic"), F.count("*")).first()
    if not toxic:
        return ToxicityModel({}, np.zeros(0), -60.0, 0.0)
    order = [F.xxhash64(F.col(id_col)), F.col(id_col)]
    positives = known.filter("toxic = 1").select(id_col).orderBy(*order).limit(POSITIVES).withColumn("positive", F.lit(True))
    others = df.filter(trains & F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(*order).limit(UNLABELLED).withColumn("positive", F.lit(False))
    chosen = materialised(positives.union(others))  # POSITIVES + UNLABELLED rows at most

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            found = [sorted({f for w in set(t.split()) for f in word_features(w)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.list_(pa.string()))], ["positive", "features"])

    texts = df.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    sampled = texts.join(F.broadcast(chosen), id_col).select("positive", "text")
    rows = materialised(sampled.mapInArrow(featurise, "positive boolean, features array<string>").withColumn("row", F.monotonically_increasing_id()))
    n_pos, n_unl = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_pos or not n_unl:
        return ToxicityModel({}, np.zeros(0), -60.0, 0.0)
    exploded = rows.select("row", "positive", F.explode("features").alias("feature"))
    seen = exploded.groupBy("feature").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    lift = (F.col("p") / n_pos) / ((F.col("u") + 1) / n_unl)
    chosen_features = (
        seen.filter(F.col("p") >= max(3, n_pos // 500)).withColumn("gain", F.col("p") * F.log(lift)).filter(lift > 1.5)
        .orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature")
    )
    index = {r.feature: i for i, r in enumerate(chosen_features.collect())}
    if not index:
        return ToxicityModel({}, np.zeros(0), -60.0, 0.0)
    names = list(index)
    kept = rows.select("positive", F.array_intersect("features", F.array(*map(F.lit, names))).alias("features")).collect()
    x = np.zeros((len(kept), len(index)), np.float32)
    for i, r in enumerate(kept):
        x[i, [index[f] for f in r.features]] = 1
    weights, bias = fit_nnpu(x, np.array([r.positive for r in kept]), float(toxic) / n)
    return ToxicityModel(index, weights, bias, float(toxic) / n)


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of toxicity in ``out``."""
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for batch in in_chunks(batches, "__text"):
            scores = model.scores(batch.column("__text").to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores)], [*kept, out])

    return df.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(F.col(f"`{text_col}`")).alias("__text")).mapInArrow(run, schema)
