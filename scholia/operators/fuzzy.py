"""Pairs of names within some edits of each other, without comparing all names of a block.

A name is cut into one piece more than edits are allowed, so that one piece at least comes
through whole, shifted by as many places at most.  Pieces meet by equality; only names that
share one are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _piece(n: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """(start, size) of piece ``i`` of a name of ``n`` characters; the last are the longer ones."""
    parts = edits + 1
    shorter = parts - n % parts
    size = F.floor(n / parts).cast("int") + (i >= shorter).cast("int")
    return (i * F.floor(n / parts) + F.greatest(F.lit(0), i - shorter)).cast("int"), size


def _key(n: Column, i: Column, text: Column) -> Column:
    return F.concat_ws("|", n.cast("string"), i.cast("string"), text)


def pieces(name: Column, edits: int) -> Column:
    n = F.length(name)
    of = lambda i: _key(n, i, F.substring(name, _piece(n, i, edits)[0] + 1, _piece(n, i, edits)[1]))
    return F.transform(F.sequence(F.lit(0), F.lit(edits)), of)


def probes(name: Column, edits: int) -> Column:
    """Keys of all pieces that a name within so many edits could have left in this one."""
    places = [(d, i, s) for d in range(-edits, edits + 1) for i in range(edits + 1) for s in range(-edits, edits + 1)]
    tried = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in places))
    own = F.length(name)

    def key(t: Column) -> Column:
        start, size = _piece(own + t["d"], t["i"], edits)
        at = start + t["s"]
        return F.when((own + t["d"] >= 0) & (at >= 0) & (at + size <= own), _key(own + t["d"], t["i"], F.substring(name, at + 1, size)))

    return F.array_distinct(F.array_compact(F.transform(tried, key)))


def candidates(left: DataFrame, right: DataFrame, block: list[str], name: str, other: str, edits: int) -> DataFrame:
    """Different (block, name, other) that share a piece; names and blocks without nulls."""
    a = left.select(*block, name).distinct().withColumn("key", F.explode(pieces(F.col(name), edits)))
    b = right.select(*block, other).distinct().withColumn("key", F.explode(probes(F.col(other), edits)))
    return a.join(b, [*block, "key"]).select(*block, name, other).distinct()


def within(left: DataFrame, right: DataFrame, block: list[str], name: str, other: str, edits: int) -> DataFrame:
    """(block, name, other, distance) of all pairs of a block up to ``edits`` apart."""
    met = candidates(left, right, block, name, other, edits)
    return met.withColumn("distance", F.levenshtein(name, other, edits)).filter("distance >= 0")
