"""Visits, prompts, revisions and retention over record tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The last ``n`` rows of each group, numbered from the newest."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", rank).filter(F.col("place") <= n)


def page(df: DataFrame, key: str, after: int | None, size: int) -> DataFrame:
    """One page by key: rows after the last key of the page before.  Only the page's
    rows are sorted out of each partition; nothing counts through skipped rows."""
    kept = df if after is None else df.filter(F.col(key) > after)
    return kept.orderBy(key).limit(size)


def expired(created: Column, now: datetime.datetime, days: int = 30) -> Column:
    return created.cast("timestamp") + F.expr(f"interval {int(days)} days") <= F.lit(now)


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key over what is stored and what came in."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return latest(both, keys, [F.desc("__new"), F.desc(order)]).drop("__new", "place")


def concat_ordered(df: DataFrame, group: list[str], order: str, text: str, separator: str = "") -> DataFrame:
    """Pieces of each group as one string, in order, and the last place."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.groupBy(*group).agg(F.array_join(pieces, separator).alias(text), F.max(order).alias("last"), F.count("*").alias("n_pieces"))


def framed(stream: DataFrame, column: str = "value", mark: str = "endendend") -> DataFrame:
    """Frames between a delimiter, numbered, empty ones dropped."""
    frames = stream.select("*", F.posexplode(F.split(column, mark)).alias("frame", "body"))
    return frames.filter(F.length(F.trim("body")) > 0)


def user_line(pairs: list[tuple[str, Column]]) -> Column:
    """``name: value`` parts of what is not blank."""
    return F.concat_ws(", ", *(F.when(F.length(F.trim(v.cast("string"))) > 0, F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in pairs))


def offsets(total: Column, offset: int, size: int) -> tuple[Column, Column]:
    """Offsets of the next and the previous page, null where there is none."""
    after = F.when(total > offset + size, F.lit(offset + size))
    return after, F.lit(max(0, offset - size) if offset > 0 else None).cast("int")


def carried_forward(visits: DataFrame, person: str, order: list[Column], cleared: list[str], date: str, today: Column) -> DataFrame:
    """A new visit for each person: the latest one again, with a new date and without what
    belongs to a single visit."""
    newest = latest(visits, [person], order).drop("place")
    kinds = {f.name: f.dataType for f in visits.schema}
    for c in cleared:
        newest = newest.withColumn(c, F.lit(None).cast(kinds[c]))
    return newest.withColumn(date, today.cast(kinds[date]))
