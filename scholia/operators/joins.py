"""Joins a corpus needs beyond plain keys: tiers, guards, ranges, overlaps, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def two_tier(df: DataFrame, exact: DataFrame, loose: DataFrame, exact_keys: list[str], loose_keys: list[str], value: str) -> DataFrame:
    """``df`` with the value of the rule on all keys, else of the rule on the looser ones."""
    a = exact.select(*exact_keys, F.col(value).alias("__exact"))
    b = loose.select(*loose_keys, F.col(value).alias("__loose"))
    joined = df.join(a, exact_keys, "left").join(b, loose_keys, "left")
    return joined.withColumn(value, F.coalesce("__exact", "__loose")).drop("__exact", "__loose")


def guarded_rename(df: DataFrame, fixes: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` by fixes.new where it equals fixes.old; ``applied`` is null where
    no fix names the key."""
    joined = df.join(fixes.select(key, "old", "new"), key, "left")
    applied = F.col(column) == F.col("old")
    renamed = F.when(applied, F.col("new")).otherwise(F.col(column))
    return joined.withColumn("applied", applied).withColumn(column, renamed).drop("old", "new")


def expand_ranges(ranges: DataFrame, low: str, high: str, out: str) -> DataFrame:
    return ranges.withColumn(out, F.explode(F.sequence(low, high)))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of intervals [start, stop) (long columns l_start.. and r_start..) that overlap
    and share the keys.

    Both sides are dealt to buckets of ``width``; a pair is emitted in the bucket where
    the later one starts, so it appears once and no bucket sees more than its own."""
    bucket = lambda start, stop: F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width)))
    a = left.filter("l_stop > l_start").withColumn("bucket", bucket("l_start", "l_stop"))
    b = right.filter("r_stop > r_start").withColumn("bucket", bucket("r_start", "r_stop"))
    pairs = a.join(b, [*keys, "bucket"]).filter("l_start < r_stop and r_start < l_stop")
    return pairs.filter(F.col("bucket") == F.floor(F.greatest("l_start", "r_start") / width)).drop("bucket")


def chains(nodes: DataFrame) -> DataFrame:
    """(id, chain, state) of every node of (id, up, step): the steps from the top down to it.

    Depth does not matter: each round doubles how far up every node has looked, so a chain
    of a thousand takes ten.  ``state`` is "whole", "orphan" (the top's ``up`` is no node;
    its chain starts there) or "cycle" (no top is reached; no chain)."""
    nodes = stored(nodes.select("id", "up", "step"))
    tops = nodes.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    based = nodes.join(tops, "up", "left").select("id", "step", F.when(F.col("known"), F.col("up")).alias("far"), (F.col("up").isNotNull() & F.col("known").isNull()).alias("orphan"))
    based = stored(based)
    looked, reach, n = based.select("id", "far"), 1, based.count()
    while reach <= n and not looked.filter("far is not null").isEmpty():
        beyond = looked.select(F.col("id").alias("far"), F.col("far").alias("next"))
        looked = stored(looked.join(beyond, "far", "left").select("id", F.col("next").alias("far")))
        reach *= 2
    # who still looks at a node from further away than there are nodes goes round in circles
    circles = looked.filter("far is not null").select("id")
    chained = stored(based.join(circles, "id", "left_anti").select("id", "far", F.array("step").alias("chain"), "orphan"))
    while not chained.filter("far is not null").isEmpty():
        above = chained.select(F.col("id").alias("far"), F.col("far").alias("next"), F.col("chain").alias("above"), F.col("orphan").alias("lost"))
        chained = stored(
            chained.join(above, "far", "left").select(
                "id", F.col("next").alias("far"), F.concat(F.coalesce("above", F.slice("chain", 1, 0)), "chain").alias("chain"), (F.col("orphan") | F.coalesce("lost", F.lit(False))).alias("orphan")
            )
        )
    whole = chained.select("id", "chain", F.when(F.col("orphan"), "orphan").otherwise("whole").alias("state"))
    return whole.unionByName(circles.select("id", F.lit("cycle").alias("state")), allowMissingColumns=True)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, path, level, state): names from the root down, from (id, parent, name); see chains()."""
    found = chains(nodes.select("id", F.col("parent").alias("up"), F.col("name").alias("step")))
    return found.select("id", F.col("chain").alias("path"), (F.size("chain") - 1).alias("level"), "state")


def best_per(df: DataFrame, group: list[str], order: list[Column], n: int = 1, out: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    ranked = df.withColumn(out or "__rank", rank).filter(F.col(out or "__rank") <= n)
    return ranked if out else ranked.drop("__rank")
