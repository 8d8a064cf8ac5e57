"""Sources and sinks: nested page documents, packed archives, text, tables, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.entries import BODY, FIELDS
from ..operators.quality import contiguous, digest
from .versions import publish

#: The schema of a recognised page, and the version that readers accept.
PAGE = (
    "pdf_page int, volume int, book_page int, layout string, "
    "regions array<struct<name:string,crop:array<double>,lines:array<struct<text:string,confidence:double,box:array<array<double>>>>>>"
)
SCHEMA_VERSION = "1"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page document (one JSON object per file or per line)."""
    return spark.read.schema(PAGE).option("multiLine", False).json(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference table kept as one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Schemas of the symptom index and of the event streams.
SYMPTOMS = "term string, category struct<major:string,minor:string>, entry_ids array<string>, source struct<volume:int,pdf_pages:array<int>,book_pages:array<int>>"
ACTIONS = "encounter string, at long, version long, action string, data string, ts timestamp"
CHUNKS = "recording string, at long, index int, duration_ms int, checksum string, ts timestamp"
SNAPSHOTS = "recording string, at long, sequence long, closed boolean, recover boolean, body string, ts timestamp"


def read_symptoms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, links) of a symptom index: a term's id is a hash of where it stands, so that
    it is the same on every run."""
    rows = read_lines(spark, path, SYMPTOMS).withColumn("term_id", F.xxhash64("category.major", "category.minor", "term"))
    terms = rows.select("term_id", "term", "category.major", "category.minor", "source.book_pages")
    return terms, rows.select("term_id", F.explode(F.array_distinct("entry_ids")).alias("id"))


def stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream over JSON files of events, at most so many files to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A database table read in ranges of its key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def check_pages(pages: DataFrame) -> DataFrame:
    return contiguous(pages, "pdf_page")


def pack(pages: DataFrame, path: str, parts: int = 8) -> None:
    """Many small page files as a few compressed ones in page order."""
    ordered = pages.repartitionByRange(parts, "pdf_page").sortWithinPartitions("pdf_page")
    ordered.write.mode("overwrite").option("compression", "gzip").json(path)


def pending(expected: DataFrame, done: DataFrame, key: str = "pdf_page") -> DataFrame:
    """What has not been processed yet."""
    return expected.join(done.select(key), key, "left_anti")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; the job's committer makes them visible all at once."""
    df.write.mode("overwrite").json(path)


#: What stands in place of text that a missing page took along.
NOTICES = {
    "source_page_missing": "【资料状态】原始扫描缺页，正文尚待其他可靠版本补全；当前记录不得进入RAG。",
    "partial_source_page_missing": "【资料状态】原始扫描前页缺失，仅保留可见的后半段；当前记录不得进入RAG。",
}


def entry_text(entry_id: Column, name: Column, fields: Column, status: Column, book_pages: Column) -> Column:
    """An entry as text: its header, a notice where a page is missing, 【label】value lines in
    the order of the labels, and its pages."""
    rank = F.create_map(*(F.lit(x) for i, f in enumerate((BODY, *FIELDS)) for x in (f, i)))
    placed = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(F.coalesce(F.element_at(rank, e["key"]), F.lit(99)).alias("place"), e["key"].alias("key"), e["value"].alias("value"))))
    lines = F.transform(placed, lambda e: F.concat(F.lit("【"), e["key"], F.lit("】"), e["value"]))
    notice = F.element_at(F.create_map(*(F.lit(x) for kv in NOTICES.items() for x in kv)), F.coalesce(status, F.lit("complete")))
    pages = F.concat(F.lit("【页码】"), F.array_join(book_pages.cast("array<string>"), ","))
    return F.array_join(F.concat(F.array(F.concat_ws(" ", entry_id, name)), F.array_compact(F.array(notice)), lines, F.array(pages)), "\n")


def page_text(lines: DataFrame, group: list[str], first: int) -> DataFrame:
    """(group, pdf_page, text): the lines of each page as read, under a banner that names
    the page of the file and, from ``first`` on, of the book."""
    number = F.lpad(F.col("pdf_page").cast("string"), 4, "0")
    book = F.when(F.col("pdf_page") >= first, F.concat(F.lit(" / BOOK_PAGE "), (F.col("pdf_page") - (first - 1)).cast("string")))
    banner = F.concat(F.lit("===== PDF_PAGE "), number, F.coalesce(book, F.lit("")), F.lit(" ====="))
    ordered = F.array_sort(F.collect_list(F.struct("region_index", "line_index", "text")))
    pages = lines.groupBy(*group, "pdf_page").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("said"))
    return pages.select(*group, "pdf_page", F.concat_ws("\n", banner, "said").alias("text"))


def section_lines(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Lines of pages inside a section's range (section, first, last), labelled with it; the
    ranges are a table of a few rows."""
    return lines.join(F.broadcast(sections), F.col("pdf_page").between(F.col("first"), F.col("last"))).drop("first", "last")


def write_text(entries: DataFrame, path: str, volume: str = "volume") -> None:
    """Rendered entries (volume, text) as text files, a folder per volume."""
    entries.select(volume, F.col("text").alias("value")).write.mode("overwrite").partitionBy(volume).text(path)


def write_outputs(entries: DataFrame, lines: DataFrame, listing: DataFrame, path: str, low: float = 0.7) -> DataFrame:
    """Entries, their listing, what needs review, the lines in doubt and a quality report, with
    a manifest row for each: one version, visible all at once.  Entries are computed once:
    the rest is read from what was written."""
    names = ("entries", "toc", "needs_review", "low_confidence", "quality")

    def manifest(done: dict[str, DataFrame]) -> DataFrame:
        rows = [digest(done[n]).select(F.lit(n).alias("output"), F.lit(SCHEMA_VERSION).alias("schema_version"), "n_rows", "digest") for n in names]
        return reduce(DataFrame.unionByName, rows)

    def quality(done: dict[str, DataFrame]) -> DataFrame:
        kept = done["entries"]
        doubtful = lines.agg(F.count_if(F.col("confidence") < low).alias("lines_in_doubt"), F.count("*").alias("lines"), F.avg("confidence").alias("mean_confidence"))
        flagged = kept.agg(F.count("*").alias("entries"), F.count_if(F.size("flags") > 0).alias("flagged"))
        return flagged.join(doubtful)  # one row each

    outputs = {
        "entries": entries, "toc": listing, "needs_review": lambda done: done["entries"].filter(F.size("flags") > 0), "low_confidence": lines.filter(F.col("confidence") < low),
        "quality": quality, "manifest": manifest,
    }
    return publish(entries.sparkSession, path, outputs)["manifest"]


def merge_corpus(volumes: list[DataFrame], path: str) -> dict[str, DataFrame]:
    """Volumes (volume, id, name, flags, record_status, ...) as one corpus, the entries kept
    out of it, those to review, names still in dispute, and a summary per volume: one
    version, visible all at once."""
    complete = F.coalesce(F.col("record_status"), F.lit("complete")) == "complete"
    outputs = {
        "corpus": merge_volumes(volumes),
        "exclusions": lambda done: done["corpus"].filter(~complete).select("volume", "id", "name", "record_status"),
        "review": lambda done: done["corpus"].filter(F.size("flags") > 0).select("volume", "id", "name", "flags"),
        "unresolved": lambda done: done["corpus"].filter(F.array_contains("flags", "name_differs_from_toc")).select("volume", "id", "name"),
        "summary": lambda done: done["corpus"].groupBy("volume").agg(F.count("*").alias("entries"), F.count_if(complete).alias("complete"), F.count_if(~complete).alias("excluded"), F.count_if(F.size("flags") > 0).alias("flagged")),
    }
    return publish(volumes[0].sparkSession, path, outputs, {"corpus": "volume"})


def export_visits(visits: DataFrame, path: str, names: dict[str, str]) -> None:
    """All filtered rows under the shown column names, as CSV with a header."""
    visits.select(*(F.col(c).alias(n) for c, n in names.items())).write.mode("overwrite").csv(path, header=True)


def merge_volumes(volumes: list[DataFrame]) -> DataFrame:
    """Volumes as one corpus; a column that one of them lacks is null there."""
    out = volumes[0]
    for v in volumes[1:]:
        out = out.unionByName(v, allowMissingColumns=True)
    return out


def compatible(meta: DataFrame, corpus_digest: str, least: int = 300, most: int = 500) -> DataFrame:
    """One row of readiness checks over a core set's metadata."""
    return meta.select(
        (F.col("schema_version") == SCHEMA_VERSION).alias("version_ok"),
        F.col("n_rows").between(least, most).alias("size_ok"),
        (F.col("corpus_digest") == corpus_digest).alias("corpus_ok"),
    )


def excluded(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status, n) of entries kept out of the corpus, and the (volume, page) that are blank,
    each once."""
    out = entries.filter(F.coalesce("record_status", F.lit("complete")) != "complete")
    blank = out.filter("record_status = 'source_page_missing'").select("volume", F.explode("pdf_pages").alias("page")).distinct()
    return out.groupBy("record_status").agg(F.count("*").alias("n")), blank
