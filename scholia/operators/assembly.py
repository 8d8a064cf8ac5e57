"""Entries out of ordered lines: headers carried forward, fields gathered in order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import stored


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, bucket: Column | None = None) -> DataFrame:
    """The latest non-null value at or before each row.

    With a ``bucket`` (a number that never falls along the order) a group is not one task:
    each bucket carries its own values, and gets what those before it end with."""
    if bucket is None:
        seen = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(seen))
    marked = df.withColumn("__value", value).withColumn("__bucket", bucket)
    ends = marked.groupBy(*group, "__bucket").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__end"))
    earlier = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*group, "__bucket", F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = marked.withColumn("__own", F.last("__value", ignorenulls=True).over(inside))
    kept = [F.col(c) for c in df.columns if c != out]
    joined = own.alias("own").join(carried.withColumnsRenamed({c: f"__of_{c}" for c in (*group, "__bucket")}).alias("carried"), [F.col(f"own.{c}").eqNullSafe(F.col(f"carried.__of_{c}")) for c in (*group, "__bucket")], "left")
    return joined.select(*kept, F.coalesce("__own", "__carried").alias(out))


def assemble(df: DataFrame, group: list[str], order: list[str], opens: Column, text: str = "text") -> DataFrame:
    """Rows from one that ``opens`` an entry up to the next become that entry; rows
    before the first are left out.  Gives the entry's number, its lines joined with the
    wrap rules, line count and length."""
    seen = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = df.withColumn("entry", F.sum(opens.cast("long")).over(seen)).filter("entry > 0")
    # an entry's lines are few; the fold keeps their order whatever the shuffle did
    lines = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("line"))))
    gathered = numbered.groupBy(*group, "entry").agg(lines.alias("lines"))
    joined = X.join_wrapped(F.transform("lines", lambda x: x["line"]))
    return gathered.select(*group, "entry", F.size("lines").alias("n_lines"), joined.alias("text"))


def cluster_rows(df: DataFrame, group: list[str], tolerance: float = 13.0) -> DataFrame:
    """Visual rows of boxes (x, y, text, confidence): a box joins the row whose running
    mean height is within the tolerance, rows read left to right.

    The mean depends on all boxes before, so a page is one group; a page is small."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in group)

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        centre = 0.0
        for box in page.sort_values(["y", "x", "text"]).itertuples():
            if rows and abs(box.y - centre) <= tolerance:
                rows[-1].append(box)
            else:
                rows.append([box])
            centre = sum(b.y for b in rows[-1]) / len(rows[-1])
        first = {k: page[k].iloc[0] for k in group}
        out = [{**first, "row": i, "text": " ".join(b.text for b in sorted(r, key=lambda b: b.x)), "confidence": min(b.confidence for b in r), "n_boxes": len(r)} for i, r in enumerate(rows)]
        return pd.DataFrame(out)

    return df.groupBy(*group).applyInPandas(fold, f"{keys}, row int, text string, confidence double, n_boxes int")


def gap_islands(df: DataFrame, group: list[str], at: str, tie: str, gap_seconds: float) -> DataFrame:
    """``df`` with the number of its island: a new one wherever the step from the row
    before exceeds the gap."""
    order = Window.partitionBy(*group).orderBy(at, tie)
    moment = F.col(at).cast("timestamp")
    step = F.unix_micros(moment) - F.unix_micros(F.lag(moment).over(order))
    opens = F.coalesce((step > int(gap_seconds * 1_000_000)).cast("int"), F.lit(1))
    return df.withColumn("__opens", opens).withColumn("island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def _accepted(found: str | None, last: str | None, alike: float) -> str | None:
    """The id of a header after ``last``: an id one digit off the expected next one is that
    one if the name resembles the listed name (ratio of 0.55 or more)."""
    if last is None or found is None:
        return found
    wanted = f"{int(last) + 1:05d}"
    off = sum(a != b for a, b in zip(found, wanted)) + abs(len(found) - len(wanted))
    return wanted if found != wanted and off <= 1 and alike >= 0.55 else found


def repair_sequence(df: DataFrame, group: list[str], order: list[str], raw: str = "raw_id", name: str = "name", toc_name: str = "toc_name", parts: int | None = None) -> DataFrame:
    """Damaged header ids by what must follow, see _accepted(); adds id and repaired.

    The expected id depends on the one accepted before.  Rows are dealt out by ranges of
    their order, and a range starts from what the range before it ended with in the last
    pass; passes go on until no range starts from anything else.  Mostly the second changes
    nothing, since an undamaged id forgets what was before it."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    alike = X.ratio(F.coalesce(name, F.lit("")), F.coalesce(toc_name, F.lit("")))
    ranged = df.withColumn("__alike", alike).repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    rows = stored(ranged.withColumn("__part", F.spark_partition_id()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def folded(frame: pd.DataFrame, starts: dict) -> tuple[pd.DataFrame, dict]:
        frame = frame.sort_values([*group, *order])
        ids, last, at, first = [], None, None, None
        for row in frame.to_dict("records"):
            volume = repr([row[g] for g in group])
            if volume != at:
                last = starts.get((row["__part"], volume)) if at is None else None
                at, first = volume, first or volume
            found = _accepted(row[raw], last, row["__alike"])
            ids.append(found)
            last = found if found is not None and found.isdigit() else last
        changed = [b is not None and a != b for a, b in zip(frame[raw], ids)]
        return frame.assign(id=ids, repaired=changed), {"part": int(frame["__part"].iloc[0]), "first": first, "end": at, "last": last}

    def ends(starts: dict) -> list:
        run = lambda frame: pd.DataFrame([folded(frame, starts)[1]])
        return sorted(rows.groupBy("__part").applyInPandas(run, "part int, first string, end string, last string").collect())  # a row for each part

    starts: dict = {}
    while True:
        found = ends(starts)
        following = {(b.part, b.first): a.last for a, b in zip(found, found[1:]) if a.end == b.first}
        if following == starts:
            break
        starts = following

    def final(frame: pd.DataFrame) -> pd.DataFrame:
        return folded(frame, starts)[0].drop(columns=["__part", "__alike"])

    return rows.groupBy("__part").applyInPandas(final, f"{kinds}, id string, repaired boolean")


def lines_of(pages: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Nested pages as one row per line, with region and line numbers, between pages."""
    kept = pages
    if first is not None:
        kept = kept.filter(F.col("pdf_page") >= first)
    if last is not None:
        kept = kept.filter(F.col("pdf_page") <= last)
    regions = kept.select("pdf_page", "book_page", "layout", F.posexplode("regions").alias("region_index", "region"))
    lines = regions.select("pdf_page", "book_page", "layout", "region_index", "region.name", "region.crop", F.posexplode("region.lines").alias("line_index", "line"))
    return lines.select("pdf_page", "book_page", "layout", F.col("name").alias("region"), "crop", "region_index", "line_index", "line.text", "line.confidence", "line.box")


#: Fixed value: signs that running headers are made of.
HEADER_SIGNS = r"^[0-9A-Za-z/=<>@()（）\s一二三四五六七八九十画总页第上下入大万寸山干土千川久卫小飞马儿元刀回国了]+$"


def drop_running_headers(lines: DataFrame, header: str = r"^\s*[0-9OoIl]{5}\s*([^\d].*?)?\s*$") -> DataFrame:
    """Lines, their blanks normalised and empty ones left out, without those at the very top
    of a two-column page that look like a running header and are not an entry's."""
    top = F.array_min(F.transform("box", lambda p: F.get(p, 1)))
    at_top = (F.col("layout") == "two_column") & (top <= F.get("crop", F.lit(1)) + 2.1)
    text = F.col("text")
    banner = F.contains(text, F.lit("总")) | ((F.length(text) <= 18) & F.rlike(text, F.lit(HEADER_SIGNS)))
    kept = lines.withColumn("text", X.normalize_space(text)).filter("text <> ''")
    return kept.filter(~F.coalesce(at_top & ~F.rlike(text, F.lit(header)) & banner, F.lit(False)))


def corrected(entries: DataFrame, fixes: DataFrame, id_col: str = "id", value: str = "text") -> DataFrame:
    """First-occurrence replacements, several per entry, in their stated order.

    ``fixes`` is (id, seq, old, new); a replacement whose old text is not there by then
    changes nothing and is counted in n_missed."""
    ordered = fixes.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("__fixes"))
    start = F.struct(F.col(value).alias("text"), F.lit(0).alias("missed"))

    def step(state: Column, fix: Column) -> Column:
        at = F.position(fix["old"], state["text"])
        replaced = F.concat(F.substring(state["text"], F.lit(1), at - 1), fix["new"], F.substring(state["text"], at + F.length(fix["old"]), F.length(state["text"])))
        return F.struct(F.when(at > 0, replaced).otherwise(state["text"]).alias("text"), (state["missed"] + (at == 0).cast("int")).alias("missed"))

    joined = entries.join(ordered, id_col, "left")
    done = F.aggregate(F.coalesce("__fixes", F.array().cast("array<struct<seq:int,old:string,new:string>>")), start, step)
    return joined.withColumn("__done", done).withColumn(value, F.col("__done.text")).withColumn("n_missed", F.col("__done.missed")).drop("__done", "__fixes")


def best_listing(rows: DataFrame) -> DataFrame:
    """One listing per id from candidates (id, pass, place, page, confidence, name) in
    order: direct ones first, the last of them holding without a page; a clustered one
    replaces what is held if nothing is, if it has a page and the held one has none, or
    if it is surer."""
    ordered = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pass", "place", "page", "confidence", "name"))).alias("c"))
    kind = "struct<page:int,confidence:double,name:string>"

    def step(held: Column, c: Column) -> Column:
        fresh = F.struct(F.when(c["pass"] > 0, c["page"]).alias("page"), c["confidence"].alias("confidence"), c["name"].alias("name")).cast(kind)
        takes = (c["pass"] == 0) | held.isNull() | (held["page"].isNull() & c["page"].isNotNull()) | (c["confidence"] > held["confidence"])
        return F.when(takes, fresh).otherwise(held)

    return ordered.select("id", F.aggregate("c", F.lit(None).cast(kind), step).alias("held")).select("id", "held.*")


def windows_around(df: DataFrame, group: str, place: str, hit: Column, radius: int) -> DataFrame:
    """Rows within ``radius`` places of a hit in the same group, each once."""
    near = Window.partitionBy(group).orderBy(place).rangeBetween(-radius, radius)
    return df.withColumn("__near", F.max(hit.cast("int")).over(near)).filter("__near = 1").drop("__near")
