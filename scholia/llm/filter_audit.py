"""Audit of how filters interact: what each removes in every order they may run in.

A document's mask says which filters it fails.  All masks, as a matrix of 0 (fails) and
"never" (passes), are combined with the inverse permutations of all orders, as a matrix
of positions, by a min-plus product: the least position among the failing filters is the
step that removes a document of that mask under that order.  Counts of documents by part
and mask are then scattered to those steps.

Only the counts by (part, mask) meet the orders, so the work on orders does not grow
with the table.  One filter may be "identical to the text of a smaller id": texts are
told apart by their SHA-256, and copies are counted group by group, never paired.

Edge cases: null texts are empty, null parts the empty string; a null id is smaller than
none, and no row is a later copy of it; rows that repeat id and text are no copies of each
other; labels of an id count if any of its rows has them; conditions that are null count
as passed; an empty table gives no rows; only the named columns are read, so further ones
never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised, text_or_empty

#: Filters at most: all their orders are listed.
MOST = 7


def orders_of(n: int) -> np.ndarray:
    """The filter at each step, for every order."""
    return np.array(list(permutations(range(n)))).reshape(-1, n)


def removal_steps(n: int) -> np.ndarray:
    """(masks, orders): the step that removes a mask's documents; n if none does."""
    position = np.argsort(orders_of(n), axis=1)
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    never = np.where(fails, 0, n)
    return np.minimum((never[:, None, :] + position[None]).min(axis=2, initial=n), n)


def interactions(weights: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Counts by part, order and step from ``weights`` (parts, masks, kinds): all
    documents, good ones and toxic ones."""
    orders, step = orders_of(n), removal_steps(n)
    at = np.arange(n)
    here = step[:, :, None] == at  # masks, orders, steps
    fails = ((np.arange(1 << n)[:, None, None] >> orders) & 1).astype(bool)  # by the filter of the step
    total = lambda kind, where: np.einsum("pm,mos->pos", weights[:, :, kind], where.astype(np.int64))
    removed = total(0, here)
    by_filter = np.zeros((len(weights), n), np.int64)
    for k in range(n):
        np.add.at(by_filter, (slice(None), orders[:, k]), removed[:, :, k])
    return {
        "kept": total(0, step[:, :, None] > at),
        "removed": removed,
        "redundant": total(0, fails & (step[:, :, None] < at)),
        "unique_fails": weights[:, 1 << orders, 0],
        "good_lost": total(1, here),
        "toxic_lost": total(2, here),
        "shapley": by_filter[:, orders],
    }


def _counted(rows: DataFrame, twin_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic) of ``rows`` (doc, part, mask, digest, good, toxic), the
    bit of later copies set."""
    keys = ["digest", "part", "mask", "good", "toxic"]
    known = F.col("doc").isNotNull()
    # a group of copies shrinks to a row for each part and kind before its rows meet
    each = rows.groupBy(*keys, "doc").agg(F.count("*").alias("n"))
    group = each.groupBy(*keys).agg(
        F.min(F.when(known, F.struct("doc", "n"))).alias("lead"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"),
    )
    least = group.groupBy("digest").agg(F.min("lead.doc").alias("least"))
    firsts = F.when(F.col("lead.doc") == F.col("least"), F.col("lead.n")).otherwise(0)
    cell = lambda mask, n: F.struct(mask.alias("mask"), n.alias("n"))
    cells = F.array(
        cell(F.col("mask"), firsts + F.col("unknown")),
        cell(F.col("mask").bitwiseOR(F.lit(twin_bit)), F.col("n") - firsts),
    )
    split = group.join(least, "digest").select("part", "good", "toxic", F.explode(cells).alias("cell")).filter("cell.n > 0")
    n = F.col("cell.n")
    return split.groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )


def audit(
    df: DataFrame, labels: DataFrame, filters: dict[str, Column], twin: str,
    part_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per part, order and step.  ``filters`` gives the failing condition of each
    letter over the columns of ``df``; the letter ``twin`` stands for later copies of a text."""
    letters = sorted([*filters, twin])
    n = len(letters)
    if n > MOST or len(set(letters)) < n:
        raise ValueError(f"{n} filters; {MOST} different ones at most")
    bit = {f: 1 << i for i, f in enumerate(letters)}
    mask = sum((F.when(c, bit[f]).otherwise(0) for f, c in filters.items()), F.lit(0))
    column = lambda c: F.col(f"`{c}`")
    rows = materialised(
        df.select(
            column(id_col).alias("doc"),
            F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part"),
            mask.alias("mask"),
            F.unhex(F.sha2(text_or_empty(column(text_col)).cast("binary"), 256)).alias("digest"),
        )
    )
    is_one = lambda c: F.coalesce(F.max(F.col(c)) == 1, F.lit(False)).alias(c)
    known = labels.select(column(id_col).alias("doc"), F.col("quality"), F.col("toxic")).filter("doc is not null")
    known = known.groupBy("doc").agg(is_one("quality"), is_one("toxic")).select("doc", F.col("quality").alias("good"), "toxic")
    no = F.lit(False)
    # rows without an id have no labels: they stay out of the join, where they would share a task
    named = rows.filter("doc is not null").join(known, "doc", "left").select(*rows.columns, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    labelled = named.unionByName(rows.filter("doc is null").select("*", no.alias("good"), no.alias("toxic")))
    counted = _counted(labelled, bit[twin])
    # 2**n cells a part at most
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    names = ["".join(letters[f] for f in order) for order in orders_of(n)]

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 64):
                some = frame.iloc[start : start + 64]
                weights = np.zeros((len(some), 1 << n, 3), np.int64)
                for i, cells in enumerate(some["cells"]):
                    for c in cells:
                        weights[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                counts = interactions(weights, n)
                each = len(names) * n
                yield pd.DataFrame(
                    {"part": np.repeat(some["part"].to_numpy(), each), "filter_order": np.tile(np.repeat(names, n), len(some)), "step": np.tile(np.arange(1, n + 1), len(some) * len(names))}
                    | {name: x.ravel() for name, x in counts.items()}
                )

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return parts.mapInPandas(spread, schema)
