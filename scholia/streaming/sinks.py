"""Sinks of streams: accepted and refused events apart, and a keyed table in buckets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import latest
from ..sources.versions import exists, listed, read_text, write_text

#: Buckets of a keyed table.
BUCKETS = 64


def split(outcomes: DataFrame, path: str, checkpoint: str, **trigger: object):
    """A started query that writes each micro-batch once, accepted and refused rows in folders
    of their own below the batch's number: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        side = F.when(F.col("accepted"), "accepted").otherwise("refused")
        batch.withColumn("side", side).write.mode("overwrite").partitionBy("side").parquet(f"{path}/batch={number}")

    return outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def side(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The "accepted" or the "refused" rows that a stream has written so far."""
    return spark.read.option("basePath", path).parquet(path).filter(F.col("side") == name).drop("side", "batch")


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int]:
    """Bucket: the batch that wrote it last, by the newest list of them (before a batch)."""
    numbers = [int(name.removesuffix(".json")) for name in listed(spark, f"{path}/versions") if name.endswith(".json")]
    numbers = [n for n in numbers if before is None or n < before]
    return json.loads(read_text(spark, f"{path}/versions/{max(numbers)}.json")) if numbers else {}


def _open(spark: SparkSession, path: str, versions: dict[str, int], wanted: list[int]) -> DataFrame | None:
    paths = [f"{path}/batch={versions[str(b)]}/bucket={b}" for b in wanted if str(b) in versions]
    return spark.read.parquet(*paths) if paths else None


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
    """Merge a batch's latest row per key into the buckets that it touches; others are not
    read.  The new buckets appear all at once, with the list that names them; a batch that is
    repeated starts from the list before it and comes to the same."""
    spark = batch.sparkSession
    rows = latest(batch, keys, [F.desc(order)]).drop("place").withColumn("bucket", bucket_of(keys, buckets))
    touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # BUCKETS rows at most
    if not touched:
        return
    versions = _versions(spark, path, number)
    old = _open(spark, path, versions, touched)
    if old is not None:
        rows = latest(rows.unionByName(old.withColumn("bucket", bucket_of(keys, buckets))), keys, [F.desc(order)]).drop("place")
    rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
    write_text(spark, f"{path}/versions/{number}.json", json.dumps(versions | {str(b): number for b in touched}))


def keyed_table(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS):
    """A started query that keeps a table of the latest row per key."""
    return stream.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, path, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def whole_table(spark: SparkSession, path: str) -> DataFrame | None:
    versions = _versions(spark, path)
    return _open(spark, path, versions, [int(b) for b in versions])


def looked_up(wanted: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame | None:
    """Rows of the keys in ``wanted``: only the newest files of their buckets are read, one
    batch's for each, however many batches there were."""
    spark = wanted.sparkSession
    needed = sorted(r["b"] for r in wanted.select(bucket_of(keys, buckets).alias("b")).distinct().collect())  # BUCKETS rows at most
    found = _open(spark, path, _versions(spark, path), needed)
    return None if found is None else found.join(wanted.select(*keys).distinct(), keys, "left_semi")


def is_table(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/versions")
