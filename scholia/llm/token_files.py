"""Token ids in Arrow files of equal-length sequences, open to random access.

``write`` encodes every document, appends an end id, deals the documents out by
ascending doc_id and writes one Arrow IPC file per partition.  A file holds
record batches of ``ids`` (fixed-size list of unsigned integers, 16 bits where
the vocabulary allows) and ``mask`` (fixed-size list of booleans; false only in
the padding of the file's last sequence), so sequence i of a file is a slice of
its memory map.  A second file beside it lists doc_id, place and length of each
document.  Files are written under a name of the attempt's own and then renamed,
so a task that runs twice leaves one whole file.

Edge cases: a null text is an empty document (its end id alone); null doc_ids
come first; rows with equal or null doc_id are dealt out and ordered by their text's
hash, so repeated rows follow each other; an empty table gives no files and no rows; other columns
of the input are not written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import in_chunks, materialised, shared_folder, text_or_empty

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE, BATCH = 2048, 256

#: Bytes of text that go to one file.
FILE_BYTES = 128 << 20

_MANIFEST = "part int, path string, n_docs long, n_tokens long, first_doc long"


def _file_schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """One data file and its list of documents."""

    def __init__(self, folder: str, kind: np.dtype, length: int):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.own = f"{base}/_{uuid.uuid4().hex}"
        self.kind, self.length = kind, length
        self.sink = self.fs.open_output_stream(self.own)
        self.out = pa.ipc.new_file(self.sink, _file_schema(pa.from_numpy_dtype(kind), length))
        self.held: list[np.ndarray] = []
        self.n_held = self.place = 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.place, len(ids)))
        self.held.append(ids)
        self.place += len(ids)
        self.n_held += len(ids)
        if self.n_held >= BATCH * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        n = len(values) // self.length if not last else -(-len(values) // self.length)
        block, rest = values[: n * self.length], values[n * self.length :]
        mask = np.ones(n * self.length, bool)
        if len(block) < n * self.length:
            mask[len(block) :] = False
            block = np.concatenate([block, np.zeros(n * self.length - len(block), self.kind)])
        if n:
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (block.astype(self.kind), mask)]
            self.out.write_batch(pa.record_batch(lists, names=["ids", "mask"]))
        self.held, self.n_held = [rest], len(rest)

    def close(self, path: str) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        index = pa.table(
            {
                "doc_id": pa.array([d[0] for d in self.docs], pa.int64()),
                "place": pa.array([d[1] for d in self.docs], pa.int64()),
                "n_tokens": pa.array([d[2] for d in self.docs], pa.int64()),
            }
        )
        _, place = self.fs.from_uri(path)
        with self.fs.open_output_stream(self.own + ".docs") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        self.fs.move(self.own, place)
        self.fs.move(self.own + ".docs", place + ".docs")


def largest_id(tokenizer_path: str) -> int:
    import json

    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def write(
    df: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    end_id: int = 0,
    wide: bool | None = None,
    length: int = SEQUENCE,
    partitions: int | None = None,
) -> DataFrame:
    """Write the files and return one row per file: part, path, n_docs, n_tokens
    and start (ids in the files before it).  Ids take 32 bits if ``wide``; if it is not
    given, where the vocabulary or the end id does not fit in 16.  An id that does not fit
    is an error."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    if wide is None:
        wide = max(largest_id(tokenizer_path), end_id) >= 1 << 16
    kind = np.dtype("<u4" if wide else "<u2")
    most = np.iinfo(kind).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        writer, first = None, None
        for batch in in_chunks(batches, "__text"):
            writer = writer or _Writer(folder, kind, length)
            coded = coder.encode(batch.column("__text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded):
                first = doc_id if first is None else first
                whole = np.append(np.frombuffer(ids, "<i4"), end_id).astype(np.int64)
                if whole.max() > most:
                    raise OverflowError(f"id {whole.max()} does not fit in {kind.itemsize} bytes")
                writer.add(doc_id, whole.astype(kind))
        if writer:
            path = f"{folder}/part-{part:06d}.arrow"
            writer.close(path)
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": path, "n_docs": len(writer.docs), "n_tokens": writer.place, "first_doc": first}],
                pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64())]),
            )

    rows = df.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("__text"))
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    dealt = rows.repartitionByRange(partitions, "doc_id", F.xxhash64("__text")).sortWithinPartitions("doc_id", F.xxhash64("__text"))
    manifest = materialised(dealt.mapInArrow(run, _MANIFEST))
    # one row per file: few, however large the corpus
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_sequences(path: str):
    """A reader over the sequences of a file; ``get_batch(i)`` maps, it does not copy."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    source = pa.memory_map(place) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)
    return pa.ipc.open_file(source)


def read_documents(files: DataFrame) -> DataFrame:
    """Read the files back: per document its start in the whole stream, its length
    and the crc32 of its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file in batch.to_pylist():
                reader = open_sequences(file["path"])
                system, place = fs.FileSystem.from_uri(file["path"] + ".docs")
                with system.open_input_file(place) as source:
                    docs = pa.ipc.open_file(source).read_all()
                sums, held, at, i = [], np.zeros(0, np.uint16), 0, 0  # held begins at position `at`
                for begin, n in zip(docs["place"].to_pylist(), docs["n_tokens"].to_pylist()):
                    blocks, have = [held[begin - at :]], len(held) - (begin - at)
                    while have < n:
                        blocks.append(reader.get_batch(i).column("ids").flatten().to_numpy())
                        have += len(blocks[-1])
                        i += 1
                    held, at = (np.concatenate(blocks) if len(blocks) > 1 else blocks[0]), begin
                    sums.append(zlib.crc32(held[:n].astype("<u4").tobytes()))
                yield pa.record_batch(
                    [
                        docs["doc_id"].combine_chunks(),
                        pa.array(docs["place"].to_numpy() + file["start"]),
                        docs["n_tokens"].combine_chunks(),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a file to a task: a stated number of partitions is not merged again
    spread = files.select("path", "start").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
