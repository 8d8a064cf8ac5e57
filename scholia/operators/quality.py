"""Quality reports over entry tables: gates, counters, gaps, roll-ups, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(df: DataFrame, status: Column, complete: str = "complete") -> DataFrame:
    """``df`` with record_status (null counts as complete) and whether it is indexed."""
    filled = F.coalesce(status, F.lit(complete))
    return df.withColumn("record_status", filled).withColumn("indexed", filled == complete)


def confidence_stats(df: DataFrame, group: list[str], confidence: Column, low: float = 0.7, medium: float = 0.8) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count("*").alias("n_lines"),
        F.round(F.avg(confidence), 6).alias("mean_confidence"),
        F.round(F.min(confidence), 6).alias("least_confidence"),
        F.count_if(confidence < low).alias("n_low"),
        F.count_if(confidence < medium).alias("n_medium"),
    )


def weighted_mean(df: DataFrame, n: str, mean: str) -> Column:
    return F.sum(F.col(n) * F.col(mean)) / F.sum(n)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_ids(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Ids absent between 1 and the largest of each group."""
    spans = df.groupBy(*group).agg(F.max(column).alias("last"))
    expected = spans.select(*group, F.explode(F.sequence(F.lit(1), F.col("last"))).alias(column))
    return expected.join(df.select(*group, column).distinct(), [*group, column], "left_anti")


def contiguous(df: DataFrame, column: str) -> DataFrame:
    """One row that tells whether a column runs without gap or repeat."""
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count("*").alias("n"), F.countDistinct(column).alias("n_distinct")).withColumn(
        "complete", F.coalesce((F.col("n") == F.col("n_distinct")) & (F.col("last") - F.col("first") + 1 == F.col("n")), F.lit(True))
    )


def not_ascending(df: DataFrame, group: list[str], order: list[Column], column: str) -> DataFrame:
    """Neighbours, in the given order, whose id does not grow."""
    before = F.lag(column).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("before", before).filter(F.col(column) <= F.col("before"))


def digest(df: DataFrame, buckets: int = 64) -> DataFrame:
    """One row with the number of rows and a digest that no order of rows changes.

    Rows are hashed and dealt to buckets; a bucket adds its hashes up as numbers, so
    neither step needs a sort or gathers rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    words = df.select(row.alias("h")).select(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket"), *(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"w{i}") for i in range(8)))
    sums = words.groupBy("bucket").agg(F.count("*").alias("n"), *(F.sum(f"w{i}").alias(f"w{i}") for i in range(8)))
    line = F.concat_ws(":", F.col("bucket"), F.col("n"), *(F.col(f"w{i}") for i in range(8)))
    return sums.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ","), 256).alias("digest"))
