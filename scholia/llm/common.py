"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts of about so many bytes are handled together inside one task.
CHUNK_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    """A null text counts as an empty one throughout this subpackage."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``modulus``; null ids fall in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors all see.

    It lies below ``spark.checkpoint.dir``; only where that is unset and Spark runs on
    this machine alone (tests) a folder of its own is chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if base is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from
    files that survive the loss of any executor, not from a long lineage."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Remove the files of a table that materialised() wrote, once nothing reads it again."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        place = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def in_chunks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches that hold about ``limit`` bytes of ``column``."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
