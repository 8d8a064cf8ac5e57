"""Formats of their own: packed page archives, streams of framed deltas, ranged tables.

``register(spark)`` makes them known; then ``spark.read.format("packed_pages")``,
``spark.readStream.format("framed_deltas")`` and ``spark.read.format("ranged_table")``.
"""

from __future__ import annotations

import gzip
import importlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .pages import PAGE

#: Name of an archive's list of members; rows of a batch.
RANGES, ROWS = "ranges.json", 500


def _system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Span(InputPartition):
    """Bytes of an archive that hold the pages from ``first`` to ``last``."""

    path: str
    start: int
    size: int
    first: int
    last: int


def write_archive(pages: Iterator[dict], path: str, per_member: int = 64) -> list[dict]:
    """Pages in order as one file of gzip members, and a list of where each begins: any
    gzip reader expands it, and a range of pages is read without the rest."""
    system, place = _system(path)
    system.create_dir(place, recursive=True)
    ranges, at = [], 0
    with system.open_output_stream(f"{place}/pages.jsonl.gz", compression=None) as out:

        def member(held: list[dict]) -> None:
            nonlocal at
            packed = gzip.compress("".join(json.dumps(p, ensure_ascii=False) + "\n" for p in held).encode(), mtime=0)
            out.write(packed)
            ranges.append({"first": held[0]["pdf_page"], "last": held[-1]["pdf_page"], "start": at, "size": len(packed), "pages": len(held)})
            at += len(packed)

        held: list[dict] = []
        for page in pages:
            if held and page["pdf_page"] <= held[-1]["pdf_page"] or (not held and ranges and page["pdf_page"] <= ranges[-1]["last"]):
                raise ValueError(f"page {page['pdf_page']} is out of order")
            held.append(page)
            if len(held) == per_member:
                member(held)
                held = []
        if held:
            member(held)
    with system.open_output_stream(f"{place}/{RANGES}") as out:
        out.write(json.dumps(ranges).encode())
    return ranges


class PackedPages(DataSource):
    """Options: path; first, last: pages wanted."""

    @classmethod
    def name(cls) -> str:
        return "packed_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackedReader(self.options, schema)


class PackedReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 2**31 - 1))

    def partitions(self) -> list[Span]:
        system, place = _system(self.path)
        with system.open_input_stream(f"{place}/{RANGES}") as source:
            ranges = json.loads(source.read())
        return [Span(self.path, r["start"], r["size"], self.first, self.last) for r in ranges if r["last"] >= self.first and r["first"] <= self.last]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        system, place = _system(span.path)
        with system.open_input_file(f"{place}/pages.jsonl.gz") as source:
            source.seek(span.start)
            lines = io.BytesIO(gzip.decompress(source.read(span.size)))
        kind = to_arrow_schema(self.schema)
        rows = [p for p in map(json.loads, lines) if span.first <= p["pdf_page"] <= span.last]
        for start in range(0, len(rows), ROWS):
            yield pa.RecordBatch.from_pylist(rows[start : start + ROWS], schema=kind)


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    stop: int


class FramedDeltas(DataSource):
    """A stream of the frames in files that grow, cut at a mark.  Options: path, mark."""

    @classmethod
    def name(cls) -> str:
        return "framed_deltas"

    def schema(self) -> str:
        return "file string, at long, body string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FramedReader(self.options)


class FramedReader(DataSourceStreamReader):
    """Offsets are bytes by file, behind the last whole frame: half a frame waits."""

    def __init__(self, options):
        self.path, self.mark = options["path"], options.get("mark", "endendend").encode()
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, place = _system(self.path)
        for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            start = self.seen.get(info.base_name, 0)
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")) and info.size > start:
                with system.open_input_file(info.path) as source:
                    source.seek(start)
                    last = source.read().rfind(self.mark)
                if last >= 0:
                    self.seen[info.base_name] = start + last + len(self.mark)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.seen = {**end, **{k: max(v, self.seen.get(k, 0)) for k, v in end.items()}}
        _, place = _system(self.path)
        return [Stretch(f"{self.path.rstrip('/')}/{name}", start.get(name, 0), stop) for name, stop in sorted(end.items()) if stop > start.get(name, 0)]

    def read(self, stretch: Stretch) -> Iterator[tuple]:
        system, place = _system(stretch.path)
        with system.open_input_file(place) as source:
            source.seek(stretch.start)
            data = source.read(stretch.stop - stretch.start)
        at = stretch.start
        for frame in data.split(self.mark)[:-1]:
            if frame.strip():
                yield stretch.path.rsplit("/", 1)[-1], at, frame.decode()
            at += len(frame) + len(self.mark)


@dataclass
class KeyRange(InputPartition):
    low: int | None
    high: int | None


class RangedTable(DataSource):
    """A database table by ranges of its key, over any Python database driver.  Options:
    driver (a module with connect), url, table, key, low, high, parts, schema."""

    @classmethod
    def name(cls) -> str:
        return "ranged_table"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangedReader(self.options, schema)


class RangedReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.columns = dict(options), schema.names
        self.key = self.options["key"]
        for word in (self.key, self.options["table"], *self.columns):
            if not word.isidentifier():
                raise ValueError(f"not a name: {word}")

    def partitions(self) -> list[KeyRange]:
        """The first and the last range are open: keys outside the bounds, and null ones in
        the first, are read as well."""
        low, high, parts = (int(self.options[c]) for c in ("low", "high", "parts"))
        edges = sorted({low + (high - low) * i // parts for i in range(1, parts)})
        return [KeyRange(a, b) for a, b in zip([None, *edges], [*edges, None])]

    def read(self, span: KeyRange) -> Iterator[tuple]:
        low = f"{self.key} >= {span.low}" if span.low is not None else None
        high = f"({self.key} < {span.high}{f' or {self.key} is null' if span.low is None else ''})" if span.high is not None else None
        condition = " and ".join(filter(None, [low, high])) or "1 = 1"
        connection = importlib.import_module(self.options["driver"]).connect(self.options["url"])
        try:
            cursor = connection.cursor()
            cursor.execute(f"select {', '.join(self.columns)} from {self.options['table']} where {condition}")
            while rows := cursor.fetchmany(ROWS):
                yield from map(tuple, rows)
        finally:
            connection.close()


def register(spark: SparkSession) -> None:
    for source in (PackedPages, FramedDeltas, RangedTable):
        spark.dataSource.register(source)
