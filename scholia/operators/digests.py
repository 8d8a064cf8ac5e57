"""Digests that tell what changed: a tree over ranges of keys, compared from the top.

A leaf covers ``width`` neighbouring keys (or hashes of keys that are not numbers), a node
FANOUT of the level below.  A node's digest adds up those of its rows, so neither order nor
partitioning matters, and two builds differ in a node only if they differ below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

FANOUT = 16


def place_of(df: DataFrame, key: str, width: int) -> Column:
    """The leaf of a row; rows without a key are in leaf -1."""
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    number = F.col(key).cast("long") if whole else F.pmod(F.xxhash64(key), F.lit(1 << 32))
    return F.coalesce(F.floor(number / width), F.lit(-1)).cast("long")


def row_digest(df: DataFrame) -> Column:
    """128 bits of a row as two numbers below 2**62, nulls and column order told apart."""
    text = F.sha2(F.to_json(F.struct(*(f"`{c}`" for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(38,0)")
    return F.struct(half(1).alias("a"), half(16).alias("b"))


def tree(df: DataFrame, key: str, width: int = 1000) -> DataFrame:
    """(level, node, n, a, b): level 0 are leaves, the last level is one node."""
    rows = df.select(place_of(df, key, width).alias("node"), row_digest(df).alias("d"))
    sums = lambda x: [F.sum("n").alias("n"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b")]
    level = stored(rows.select("node", F.lit(1).cast("long").alias("n"), "d.a", "d.b").groupBy("node").agg(*sums(0)))
    out, number = level.withColumn("level", F.lit(0)), 0
    while not level.filter("node not in (0, -1)").isEmpty():
        number += 1
        up = F.when(F.col("node") == -1, F.lit(-1)).otherwise(F.floor(F.col("node") / FANOUT)).cast("long")
        level = stored(level.withColumn("node", up).groupBy("node").agg(*sums(0)))
        out = out.unionByName(level.withColumn("level", F.lit(number)))
    return out.select("level", "node", "n", "a", "b")


def changed(old: DataFrame, new: DataFrame, width: int = 1000) -> DataFrame:
    """(low, high, n_before, n_now): ranges of keys whose rows differ between two trees of
    one width.  Only nodes below differing ones are looked at, level by level."""
    top = max(t.agg(F.max("level")).first()[0] or 0 for t in (old, new))
    side = lambda t, p: t.select("level", "node", *(F.col(c).alias(f"{c}_{p}") for c in ("n", "a", "b")))
    met = stored(side(old, "old").join(side(new, "new"), ["level", "node"], "full").filter(~(F.col("a_old").eqNullSafe(F.col("a_new")) & F.col("b_old").eqNullSafe(F.col("b_new")) & F.col("n_old").eqNullSafe(F.col("n_new")))))
    wanted = met.filter(F.col("level") == top)
    for level in range(top - 1, -1, -1):
        above = wanted.select(F.col("node").alias("up")).distinct()
        up = F.when(F.col("node") == -1, F.lit(-1)).otherwise(F.floor(F.col("node") / FANOUT)).cast("long")
        # trees of unlike height have no common top: their upper levels differ all over
        wanted = met.filter(F.col("level") == level).withColumn("up", up).join(above, "up", "left_semi").drop("up")
    edge = lambda n: F.when(F.col("node") >= 0, (F.col("node") + n) * width)
    none = F.lit(0).cast("long")
    return wanted.select(edge(0).alias("low"), edge(1).alias("high"), F.coalesce("n_old", none).alias("n_before"), F.coalesce("n_new", none).alias("n_now"))
