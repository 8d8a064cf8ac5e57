"""A volume's lines as structured entries: labels, headers, listings, flags, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .assembly import carry_forward

#: Field labels in their order, what OCR makes of some, and the field of
#: lines before any label.
FIELDS = ("方源", "异名", "组成", "制法", "用法", "功用", "主治", "宜忌", "加减", "附方", "方论选录", "临证举例", "现代研究", "备考", "备注")
ALIASES = {"来源": "方源", "方原": "方源", "组咸": "组成", "主洽": "主治", "主冶": "主治", "功效": "功用", "禁忌": "宜忌", "方论选绿": "方论选录", "临证举列": "临证举例"}
BODY = "正文"

#: Patterns of entry headers, labelled lines, listings and index ids.
HEADER = r"^\s*([0-9OoIl]{5})\s*([^\d].*?)?\s*$"
LABELLED = r"^[\[【〔(（]\s*([^\]】〕)）]{1,8})\s*[\]】〕)）]\s*(.*)$"
LISTED = r"^\s*([0-9OoIl]{5})\s*(.+?)\s*[.·…]{2,}\s*(\d{1,4})\s*$"
INDEX_ID = r"(?<![0-9OoIl])([0-9OoIl]{5})(?![0-9OoIl])"
EDGE = " -—·."

#: Pages of a volume that are read together.
PAGES = 32

#: Similarity from which an unknown label is a known one, below which a name differs from
#: its listing; confidence below which a line is unsure.
LIKE_LABEL, LIKE_NAME, SURE = 0.72, 0.70, 0.70


def labels(df: DataFrame, raw: str, known: tuple[str, ...] = FIELDS, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """``df`` with label (null if none) and method exact, alias, fuzzy or unknown.

    Only different labels that are neither known nor an alias are compared, each with
    the few known ones; the rest is a map lookup."""
    compact = F.regexp_replace(raw, r"\s+", "")
    listed = F.create_map(*(F.lit(x) for k in known for x in (k, k)), *(F.lit(x) for kv in aliases.items() for x in kv))
    marked = df.withColumn("__compact", compact).withColumn("__sure", F.element_at(listed, F.col("__compact")))
    unsure = marked.filter(F.col("__sure").isNull() & F.col("__compact").isNotNull()).select("__compact").distinct()
    tried = unsure.select("__compact", F.explode(F.array(*map(F.lit, known))).alias("__like")).withColumn("__ratio", X.ratio(F.col("__like"), F.col("__compact")))
    best = tried.filter(F.col("__ratio") >= LIKE_LABEL).groupBy("__compact").agg(F.max(F.struct("__ratio", "__like"))["__like"].alias("__like"))
    joined = marked.join(best, "__compact", "left")
    method = F.when(F.col("__compact").isin(*known), "exact").when(F.col("__sure").isNotNull(), "alias").when(F.col("__like").isNotNull(), "fuzzy").otherwise("unknown")
    return joined.withColumn("label", F.coalesce("__sure", "__like")).withColumn("method", method).drop("__compact", "__sure", "__like")


def split_fields(text: Column, known: tuple[str, ...] = FIELDS, aliases: dict[str, str] = ALIASES) -> Column:
    """The pieces of a line that holds several labelled fields; brackets around labels are
    mended and aliases replaced first."""
    names = "|".join(sorted((*known, *aliases), key=len, reverse=True))
    mended = F.regexp_replace(text, rf"[\[【〔(（]?\s*({names})\s*[\]】〕)）]", "【$1】")
    for alias, name in aliases.items():
        mended = F.replace(mended, F.lit(f"【{alias}】"), F.lit(f"【{name}】"))
    opens = f"【(?:{'|'.join(known)})】"
    pieces = F.filter(F.transform(F.split(mended, f"(?={opens})"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.regexp_count(mended, F.lit(opens)) > 1, pieces).otherwise(F.array(mended))


def header_of(text: Column) -> Column:
    """struct(id, name) of an entry header, null for other lines; a bare number is none."""
    name = F.trim(F.regexp_extract(text, HEADER, 2), F.lit(EDGE))
    opens = F.rlike(text, F.lit(HEADER)) & (name != "")
    return F.when(opens, F.struct(X.repair_id(F.regexp_extract(text, HEADER, 1)).alias("id"), name.alias("name")))


def field_of(text: Column) -> Column:
    """struct(raw, rest) of a line that begins with a bracketed label, null for others."""
    return F.when(F.rlike(text, F.lit(LABELLED)), F.struct(F.trim(F.regexp_extract(text, LABELLED, 1)).alias("raw"), F.regexp_extract(text, LABELLED, 2).alias("rest")))


def listing_of(text: Column) -> Column:
    """struct(id, name, page) of a line of a table of contents."""
    found = F.struct(X.repair_id(F.regexp_extract(text, LISTED, 1)).alias("id"), F.regexp_extract(text, LISTED, 2).alias("name"), F.regexp_extract(text, LISTED, 3).cast("int").alias("page"))
    return F.when(F.rlike(text, F.lit(LISTED)), found)


def index_ids(text: Column) -> Column:
    """Five-sign ids that stand alone in a line, repaired."""
    return F.transform(F.regexp_extract_all(text, F.lit(INDEX_ID), F.lit(1)), lambda x: X.repair_id(x))


def appendix_header(text: Column) -> Column:
    """Whether a line of the appendix is a running header."""
    return F.contains(text, F.lit("主治病证索引")) | F.contains(text, F.lit("总")) | F.rlike(text, F.lit(r"^\d{1,4}$")) | text.isin("证索引", "主治病", "画")


def book_pages(pages: Column, first: int) -> Column:
    """Pages of the book from pages of the file, the book beginning on page ``first``."""
    return F.transform(pages, lambda p: p - (first - 1))


def disputed(listed: Column, flags: Column, renamed: Column) -> Column:
    """Listed entries whose name differs from the listing or has been changed."""
    return listed.isNotNull() & (F.array_contains(flags, "name_differs_from_toc") | renamed)


def unmatched_rules(rules: DataFrame, lines: DataFrame, exact: list[str], loose: list[str]) -> DataFrame:
    """Rules that no line meets: on all keys, or on the looser ones where the others are null."""
    further = [c for c in exact if c not in loose]
    general = F.coalesce(*(F.col(c) for c in further)).isNull()
    missed = rules.filter(~general).join(lines.select(*exact), exact, "left_anti")
    return missed.unionByName(rules.filter(general).join(lines.select(*loose), loose, "left_anti").select(*missed.columns))


def colliding(placeholders: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """Placeholders for ids that have an entry after all."""
    return placeholders.join(entries.select(key), key, "left_semi")


def with_listing(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """``entries`` (id, name, flags, ...) with their listed name and page, similarity of
    the names, and flags for what is missing or differs."""
    joined = entries.join(listing.select("id", F.col("name").alias("toc_name"), F.col("page").alias("toc_page")), "id", "left")
    alike = X.ratio(F.replace("name", F.lit(" "), F.lit("")), F.replace("toc_name", F.lit(" "), F.lit("")))
    joined = joined.withColumn("name_similarity", F.round(alike, 4))
    flag = F.when(F.col("toc_name").isNull(), "missing_from_parsed_toc").when(F.col("name_similarity") < LIKE_NAME, "name_differs_from_toc")
    return joined.withColumn("flags", F.concat("flags", F.array_compact(F.array(flag))))


def build_volume(lines: DataFrame, listing: DataFrame, low: int, high: int, first_page: int = 1, group: str = "volume", order: tuple[str, ...] = ("pdf_page", "region_index", "line_index")) -> tuple[DataFrame, DataFrame]:
    """(entries, label counts) of volumes of lines (text, confidence, volume and order).

    Labelled lines are cut into their fields, headers within [low, high] open entries,
    labels carry forward inside an entry, and the lines of each field are joined.  Lines
    before a volume's first header are dropped.  A field's lines are an entry's at most,
    so the fold over them is small."""
    place = [*order, "piece"]
    bucket = F.floor(F.col(order[0]) / PAGES)  # a large volume is many tasks
    cut = lines.select("*", F.posexplode(split_fields(F.col("text"))).alias("piece", "cut"))
    cut = cut.withColumn("split", F.col("cut") != F.col("text")).withColumn("text", F.col("cut")).drop("cut")
    header = header_of(F.col("text"))
    inside = F.try_to_number(header["id"], F.lit("99999")).between(low, high)
    opened = cut.withColumn("header", F.when(inside, header))
    opened = carry_forward(opened, [group], place, F.when(F.col("header").isNotNull(), F.struct("header", *place)), "entry", bucket).filter("entry is not null")
    named = labels(opened.withColumn("labelled", F.when(F.col("header").isNull(), field_of(F.col("text")))).withColumn("raw", F.col("labelled.raw")), "raw")
    # a line whose label is unknown is ordinary text
    known = F.col("label").isNotNull()
    counts = named.filter("raw is not null").groupBy(group, "method").agg(F.count("*").alias("n"))
    counts = counts.unionByName(named.filter("split").groupBy(group).agg(F.count("*").alias("n")).withColumn("method", F.lit("embedded_split")))
    filled = carry_forward(named, [group, "entry"], place, F.when(known, F.col("label")).when(F.col("header").isNotNull(), F.lit(BODY)), "field")
    body = filled.withColumn("said", F.when(known, F.col("labelled.rest")).otherwise(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct(*place, "said")))
    said = body.filter("header is null and said <> ''").groupBy(group, "entry", "field").agg(ordered.alias("lines"))
    fields = said.select(group, "entry", F.struct("field", X.join_wrapped(F.transform("lines", lambda x: x["said"])).alias("text")).alias("f"))
    fields = fields.groupBy(group, "entry").agg(F.map_from_entries(F.array_sort(F.collect_list("f"))).alias("fields"))
    sure = F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.min("confidence"), 6).alias("minimum"), F.count("*").alias("line_count")
    facts = body.groupBy(group, "entry").agg(F.array_sort(F.collect_set("pdf_page")).alias("pages"), *sure)
    whole = facts.join(fields, [group, "entry"], "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    has = lambda f: F.map_contains_key("fields", f)
    flags = F.array_compact(F.array(F.when(F.col("minimum") < SURE, "low_confidence_line"), F.when(~has("方源") & ~has(BODY), "missing_source_field")))
    entries = whole.select(group, "entry.header.*", "fields", "mean", "minimum", "line_count", "pages", book_pages(F.col("pages"), first_page).alias("book_pages"), flags.alias("flags"))
    return with_listing(entries, listing), counts


def index_report(rows: DataFrame, canonical: DataFrame, low: float = LIKE_NAME) -> DataFrame:
    """One row on an index (id, similarity, section): its rows, ids, ids that are missing
    or double, and doubtful names."""
    per_id = rows.groupBy("id").agg(F.count("*").alias("n"), F.max("similarity").alias("best"))
    seen = per_id.agg(F.sum("n").alias("rows"), F.count("*").alias("unique_ids"), F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.count_if(F.col("best") < low).alias("low_similarity"))
    missing = canonical.select("id").join(per_id, "id", "left_anti").agg(F.count("*").alias("missing_ids"))
    return seen.join(F.broadcast(missing))  # one row each


def section_counts(rows: DataFrame, section: str = "section") -> DataFrame:
    return rows.groupBy(section).agg(F.count("*").alias("n"))


def index_record(fields: Column) -> dict[str, Column]:
    """Columns of the index from a map of fields: several labels to a column joined by
    line, and what no column takes as ``label：text`` lines in the order of the labels."""
    columns = {
        "source_text": ("方源",), "composition": ("组成",), "usage_text": ("用法", "制法"), "actions": ("功用",),
        "indications": ("主治",), "modifications": ("加减", "附方"), "cautions": ("宜忌",),
    }
    filled = lambda name: F.nullif(F.trim(F.element_at(fields, F.lit(name))), F.lit(""))
    out = {c: F.concat_ws("\n", *map(filled, names)) for c, names in columns.items()}
    taken = [n for names in columns.values() for n in names]
    rank = {n: i for i, n in enumerate((BODY, *FIELDS))}
    others = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*taken) & (F.coalesce(e["value"], F.lit("")) != ""))
    place = lambda key: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in rank.items() for x in kv)), key), F.lit(len(rank)))
    placed = F.array_sort(F.transform(others, lambda e: F.struct(place(e["key"]).alias("place"), e["key"].alias("key"), e["value"].alias("value"))))
    out["other_text"] = F.array_join(F.transform(placed, lambda e: F.concat(e["key"], F.lit("："), e["value"])), "\n")
    return out


def index_metadata(records: DataFrame, version: str, built_at: Column, indexed: Column) -> DataFrame:
    """The row that stands beside an index: version, time, counts and a digest of its records."""
    from .quality import digest

    counts = records.agg(F.count("*").alias("total"), F.count_if(indexed).alias("indexed"), F.count_if(~indexed).alias("excluded"))
    return counts.join(F.broadcast(digest(records.filter(indexed)).select("digest"))).select(F.lit(version).alias("schema_version"), built_at.alias("built_at"), "*")


def core_summary(chosen: DataFrame, n_prototypes: int) -> DataFrame:
    """One row on a core set (id, primary, prototypes, source): how many of the prototypes
    it represents, as primary ones too, and how many entries the official list gave."""
    spread = chosen.select(F.explode("prototypes").alias("p")).agg(F.countDistinct("p").alias("represented"))
    whole = chosen.agg(F.count("*").alias("entries"), F.countDistinct("primary").alias("primary_represented"), F.count_if(F.col("source") == "official").alias("official"))
    return whole.join(F.broadcast(spread)).withColumn("prototypes", F.lit(n_prototypes))


def primary_distribution(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("primary").agg(F.count("*").alias("n"))


def core_ready(chosen: DataFrame, known: list[str], digest_of_index: str, digest_at_build: str, least: int = 300, most: int = 500) -> DataFrame:
    """One row of checks on a core set: size, unique ids and names, known prototypes, and
    that it was built from this index."""
    strange = F.size(F.array_except("prototypes", F.array(*map(F.lit, known)))) > 0
    n = F.count("*")
    facts = chosen.agg(n.between(least, most).alias("size_ok"), (F.countDistinct("id") == n).alias("ids_ok"), (F.countDistinct("name") == n).alias("names_ok"), (F.count_if(strange) == 0).alias("prototypes_ok"))
    fits = facts.withColumn("index_ok", F.lit(digest_of_index == digest_at_build))
    return fits.withColumn("ready", F.col("size_ok") & F.col("ids_ok") & F.col("names_ok") & F.col("prototypes_ok") & F.col("index_ok"))
