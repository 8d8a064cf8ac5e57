"""Mixing to target weights with soft memberships, in DataFrame functions alone.

A classifier learned from a table of labelled documents gives every document a
posterior over domains (the label's values).  Document rates between 0 and
``max_rate`` are then fitted by projected-gradient least squares so that the
expected token totals of the domains, sum(rate * tokens * posterior), match the
targets.  A step needs one sum per domain over all documents, so the driver
sees as many numbers as there are domains.

What is made small is half the sum over domains of (total - target)**2 / size, with the
domain's whole token total as its size.  Measured in tokens (a document's rate weighs as
many as it has) the gradient is sum(posterior * excess), excess = (total - target) / size,
and its Lipschitz constant is 1, so a step of length 1 is safe.  Steps carry momentum,
which is dropped whenever the objective rises.  The fit ends when every excess is below
TOLERANCE, or, where posteriors overlap too much for the targets to be met, when the
objective is proven to be within GAP a token of the least one: no rates reach further
down than the gradient at the present ones promises.  ``Mixture.excess`` tells what is
left.  A fit that does neither in STEPS steps raises an error.

The classifier is naive Bayes over a few binned shape features of the text (signs,
separators, capitals, word and line lengths), counted over all labelled rows.

The domain of the largest weight keeps its full rate and so fixes the size of the
corpus; the targets of the others follow from their weights, and a domain that has
less than its target is taken whole.

Edge cases: null texts count as empty and have no tokens; labels that are null, or
of ids without a document, teach nothing; an id with several labels counts with
each; without labels all posteriors follow the weights and rates stay at
``max_rate``; null ids share one fixed draw; repeated rows and equal rates are drawn by
their ids, alike; a very long text is one document with its whole tokens; an empty table
gives none; existing columns with an output's name are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised, text_or_empty
from .quality import words_of

#: Bins of a shape feature, added count of the classifier.
BINS, ADDED = 10, 1.0

#: Distance from a domain's target, as a share of its tokens, that ends the fit; so does
#: this distance a token from the least objective.
TOLERANCE, GAP = 1e-4, 1e-5

#: Steps without an end that are an error; steps after which the rates are written out.
STEPS, WRITTEN = 1000, 8

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _log_bin(x: Column, scale: float) -> Column:
    """Bins of doubling width from 1 / scale on."""
    return F.least(F.lit(BINS - 1), F.floor(F.log2(1 + x * scale)).cast("int"))


def shape_features(text: Column, n_words: Column) -> dict[str, Column]:
    length = F.length(text)
    per_word = lambda signs: (length - F.length(F.translate(text, signs, ""))) / F.greatest(n_words, F.lit(1))
    lines = F.greatest(F.lit(1), length - F.length(F.replace(text, F.lit("\n"), F.lit(""))))
    return {
        "signs": _log_bin(per_word("#*$%&<>"), 64),
        "bars": _log_bin(per_word("|"), 64),
        "shouts": _log_bin(per_word("!"), 64),
        "stops": _log_bin(per_word(".,;:?"), 64),
        "capitals": _log_bin(per_word(_CAPITALS), 16),
        "word_length": _log_bin(length / F.greatest(n_words, F.lit(1)), 2),
        "line_words": _log_bin(n_words / lines, 1),
        "words": _log_bin(n_words, 0.25),
    }


class Mixture:
    """A fitted classifier and the steps that led from full rates to the mixture.

    Both are a few numbers per domain, so ``apply`` is a projection over any rows.
    """

    def __init__(self, domains: list[str], seen: dict[tuple[str, str, int], int], max_rate: float):
        self.domains, self.seen, self.max_rate = domains, seen, float(max_rate)
        self.steps: list[tuple[float, list[float]]] = []  # momentum, excess it leads to
        self.excess: list[float] = []  # what is left at the end
        self.size = {d: max((n for (e, _, _), n in self._totals().items() if e == d), default=0) for d in domains}

    def _totals(self) -> dict[tuple[str, str, int], int]:
        out: dict[tuple[str, str, int], int] = {}
        for (domain, feature, _), n in self.seen.items():
            out[domain, feature, 0] = out.get((domain, feature, 0), 0) + n
        return out

    def _evidence(self, domain: str, features: list[str]) -> Column:
        size, total = self.size[domain], sum(self.size.values())
        out = F.lit(math.log((size + ADDED) / (total + ADDED * len(self.domains))))
        for name in features:
            logs = [math.log((self.seen.get((domain, name, b), 0) + ADDED) / (size + ADDED * BINS)) for b in range(BINS)]
            out = out + F.get(F.array(*map(F.lit, logs)), F.col(f"__{name}"))
        return out

    def with_posteriors(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with binned features) with p, a probability per domain, for them."""
        names = [c for c in rows.columns if c.startswith("__f_")]
        kept = [F.col(f"`{c}`") for c in rows.columns if c not in (*names, "p")]
        logs = rows.select(*kept, F.array(*(self._evidence(d, [n[2:] for n in names]) for d in self.domains)).alias("__logs"))
        raw = logs.select(*kept, F.transform("__logs", lambda x: F.exp(x - F.array_max("__logs"))).alias("__raw"))
        norm = raw.select("*", F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x).alias("__norm"))
        return norm.select(*kept, F.transform("__raw", lambda x: x / F.col("__norm")).alias("p"))

    def taken(self, steps: list[tuple[float, list[float]]], now: Column, before: Column) -> Column:
        """(now, before): the rates after some more steps and those one step earlier."""
        state = lambda now, before: F.struct(now.alias("now"), before.alias("before"))
        if not steps:
            return state(now, before)

        def step(at: Column, s: Column) -> Column:
            downhill = sum((F.get("p", F.lit(k)) * F.get(s["excess"], F.lit(k)) for k in range(len(self.domains))), F.lit(0.0))
            moved = at["now"] + s["momentum"] * (at["now"] - at["before"]) - downhill
            return state(F.least(F.lit(self.max_rate), F.greatest(F.lit(0.0), moved)), at["now"])

        listed = F.array(*(F.struct(F.lit(m).alias("momentum"), F.array(*map(F.lit, e)).alias("excess")) for m, e in steps))
        return F.aggregate(listed, state(now, before), step)

    def with_rates(self, members: DataFrame, id_col: str) -> DataFrame:
        full = F.lit(self.max_rate)
        rated = members.withColumn("rate", F.round(self.taken(self.steps, full, full)["now"], 9))
        return rated.withColumn("copies", draw(F.col("rate"), F.col(f"`{id_col}`")))

    def apply(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``df``, text and all, with tokens, p, rate and copies."""
        return self.with_rates(self.with_posteriors(featurised(df, text_col)), id_col)


def featurised(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with tokens and a column per binned feature."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("tokens", "p", "rate", "copies")]
    text = text_or_empty(F.col(f"`{text_col}`"))
    rows = df.select(*kept, F.size(words_of(text)).cast("long").alias("tokens"))
    return rows.select("*", *(c.alias(f"__f_{n}") for n, c in shape_features(text, F.col("tokens")).items()))


def fit(df: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", max_rate: float = 1.0, keep_text: bool = False) -> tuple[Mixture, DataFrame]:
    """The mixture, and its members: ``df`` with tokens and p, the text only if kept."""
    domains = sorted(weights)
    rows = featurised(df, text_col)
    rows = materialised(rows if keep_text else rows.drop(text_col))
    names = [c for c in rows.columns if c.startswith("__f_")]
    known = labels.select(F.col(id_col), F.col(label_col).cast("string").alias("__domain")).filter(F.col("__domain").isin(domains))
    taught = rows.select(id_col, *names).join(known, id_col).select("__domain", *names)
    pairs = F.array(*(F.struct(F.lit(n[2:]).alias("feature"), F.col(n).alias("bin")) for n in names))
    cells = taught.select("__domain", F.explode(pairs).alias("x")).groupBy("__domain", "x.feature", "x.bin").count()
    seen = {(r["__domain"], r["feature"], r["bin"]): r["count"] for r in cells.collect()}  # domains x features x bins at most
    mixture = Mixture(domains, seen, max_rate)
    settle(mixture, mixture.with_posteriors(rows.select("tokens", *names)), [weights[d] for d in domains])
    return mixture, mixture.with_posteriors(rows)


def settle(mixture: Mixture, members: DataFrame, wanted: list[float]) -> None:
    """Find the steps that lead from full rates to the wanted weights of ``members`` (tokens, p)."""
    full = F.lit(mixture.max_rate)
    count, order = len(wanted), range(len(wanted))
    # documents of one posterior keep one rate: they count as one member with all their tokens
    members = members.groupBy("p").agg(F.sum("tokens").alias("tokens"))
    members = materialised(members.select("tokens", "p", full.alias("now"), full.alias("before")))
    part = lambda rate, k: F.sum(rate * F.col("tokens") * F.get("p", F.lit(k)))
    first = members.agg(*(part(F.lit(1.0), k) for k in order), F.sum("tokens")).first()
    whole, tokens = [x or 0.0 for x in first[:count]], first[count] or 0
    most = max(order, key=lambda k: (wanted[k], -k))
    budget = mixture.max_rate * whole[most] / wanted[most]
    targets = [min(mixture.max_rate * a, w * budget) for a, w in zip(whole, wanted)]
    distance = lambda totals: [(x - t) / a if a else 0.0 for x, t, a in zip(totals, targets, whole)]
    size = lambda excess: sum(a * e * e for a, e in zip(whole, excess))
    now = before = distance([mixture.max_rate * a for a in whole])
    since, written = 0, 0
    while max(map(abs, now), default=0.0) >= TOLERANCE:
        if len(mixture.steps) >= STEPS:
            raise RuntimeError(f"no mixture after {STEPS} steps; excess by domain {dict(zip(mixture.domains, now))}")
        since = since + 1 if size(now) <= size(before) else 0
        momentum = max(0.0, (since - 1) / (since + 2))
        mixture.steps.append((momentum, [n + momentum * (n - b) for n, b in zip(now, before)]))
        state = mixture.taken(mixture.steps[written:], F.col("now"), F.col("before"))
        stepped = members.select("tokens", "p", state.alias("__at"))
        if len(mixture.steps) - written == WRITTEN:
            members = materialised(stepped.select("tokens", "p", "__at.now", "__at.before"))
            stepped = members.select("tokens", "p", F.struct("now", "before").alias("__at"))
            written = len(mixture.steps)
        # how far down the gradient at the rates before this step could lead at most
        slope = sum((F.get("p", F.lit(k)) * F.lit(e) for k, e in enumerate(now)), F.lit(0.0))
        rate = F.col("__at.before")
        gap = F.sum(F.col("tokens") * F.when(slope > 0, slope * rate).otherwise(-slope * (full - rate)))
        sums = [x or 0.0 for x in stepped.agg(*(part(F.col("__at.now"), k) for k in order), gap).first()]
        if sums[count] <= GAP * tokens:
            mixture.steps.pop()
            break
        before, now = now, distance(sums[:count])
    mixture.excess = now


def draw(rate: Column, id_col: Column) -> Column:
    """Copies of a document: the whole part of its rate, and one more with the rest's
    probability, by a hash of its id."""
    u = (F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def mix(df: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", max_rate: float = 1.0) -> DataFrame:
    """(id, tokens, p, rate, copies) of every row; ``weights`` gives the wanted share
    of tokens of each domain."""
    mixture, members = fit(df, labels, weights, id_col, label_col, text_col, max_rate)
    return mixture.with_rates(members, id_col)
