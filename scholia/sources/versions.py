"""Outputs that appear all at once: folders of a version, and a pointer switched last.

A reader follows the pointer, so it sees the outputs of one job, never some of one and some
of another.  A job that dies leaves the version before it readable, and a folder that the
next clearing removes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    files, place = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _files(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written aside, then renamed."""
    files, place = _files(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid.uuid4().hex}")
    stream = files.create(aside)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.exists(place):
        files.delete(place, False)
    if not files.rename(aside, place):
        raise OSError(f"cannot rename to {path}")


def publish(spark: SparkSession, path: str, outputs: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], partitioned: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Write all outputs as a new version of ``path`` and switch to it.  An output may be a
    function of those before it, which are then read from what was written."""
    version = uuid.uuid4().hex
    done: dict[str, DataFrame] = {}
    for name, output in outputs.items():
        df = output(done) if callable(output) else output
        writer = df.write.mode("errorifexists")
        if partitioned and name in partitioned:
            writer = writer.partitionBy(partitioned[name])
        writer.parquet(f"{path}/versions/{version}/{name}")
        done[name] = spark.read.parquet(f"{path}/versions/{version}/{name}")
    write_text(spark, f"{path}/{POINTER}", version)
    return done


def current(spark: SparkSession, path: str) -> str | None:
    return read_text(spark, f"{path}/{POINTER}") if exists(spark, f"{path}/{POINTER}") else None


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An output as the last whole job left it."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/versions/{version}/{name}")


def cleared(spark: SparkSession, path: str) -> list[str]:
    """Remove versions that the pointer does not name; for when no job writes or reads them."""
    files, _ = _files(spark, path)
    gone = [v for v in listed(spark, f"{path}/versions") if v != current(spark, path)]
    for version in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version}"), True)
    return gone
