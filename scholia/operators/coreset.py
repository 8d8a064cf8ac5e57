"""The core set: admission, one record per name, authority, and the order it fills up in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .joins import best_per

#: Names and sources that are not classic, references that carry authority.
PLAIN_NAME = r"(?:[一二三四五六七八九十\d]+号|自拟|经验|协定|医院)"
PLAIN_SOURCE = r"(?:中药制剂手册|全国中药成药处方集|临床经验|医院|研究所|医药杂志|中医杂志|通讯)"
TEXTBOOK = r"《(?:中医)?方剂学(?:讲义|临床手册)?》|《方剂学》|《中医方剂选讲》|《中医方剂临床手册》|《中国医学百科全书[·•]方剂学》"
STANDARD = r"《中国药典》|《中医大辞典[·•]方剂分册》"
WORK = r"《([^》]{2,40})》"
MOST_WORKS = 40


def filled(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def admitted(facts: list[Column], volume: Column, pages: list[Column], flags: Column, name: Column, source: Column) -> Column:
    """Whether a record has all its facts and places, no flags, and a classic name and source."""
    out = F.coalesce(volume, F.lit(0)) != 0
    for f in facts:
        out = out & filled(f)
    for p in pages:
        out = out & (F.size(F.coalesce(p, F.array().cast("array<int>"))) > 0)
    return out & (F.size(flags) == 0) & ~F.rlike(name, F.lit(PLAIN_NAME)) & ~F.rlike(source, F.lit(PLAIN_SOURCE))


def authority(actions: Column, indications: Column, cautions: Column, other: Column) -> Column:
    """struct of six facts: textbook, standard, works cited, commentary, cautions, cases."""
    said = F.concat_ws("\n", actions, indications, cautions, other)
    flag = lambda c: c.cast("int")
    works = F.least(F.lit(MOST_WORKS), F.size(F.array_distinct(F.regexp_extract_all(said, F.lit(WORK), F.lit(1)))))
    return F.struct(
        flag(F.rlike(said, F.lit(TEXTBOOK))).alias("textbook"), flag(F.rlike(said, F.lit(STANDARD))).alias("standard"), works.alias("works"),
        flag(F.contains(other, F.lit("方论选录"))).alias("commentary"), flag(filled(cautions)).alias("cautions"), flag(F.contains(other, F.lit("临证举例"))).alias("cases"),
    )


def record_quality(facts: list[Column], pages: list[Column], key: Column) -> Column:
    """How complete a record is; of equals the shorter id, then the larger."""
    complete = sum((filled(f).cast("int") for f in facts), F.lit(0))
    places = sum(((F.size(p) > 0).cast("int") for p in pages), F.lit(0))
    return F.struct(complete.alias("complete"), places.alias("places"), (-F.length(key)).alias("brevity"), key.alias("key"))


def chosen_records(records: DataFrame, expected: DataFrame) -> DataFrame:
    """One record (id, name, source, quality) for each name, with ``official``.

    ``expected`` (name, official_source, parent_source) is a table of some hundred names.
    A record of the official source goes before one of the parent's; a name that is
    expected from either and found in neither has no record."""
    name = X.normalize(F.col("name"))
    wanted = expected.select(X.normalize(F.col("name")).alias("__name"), X.normalize(F.col("official_source")).alias("__official"), X.normalize(F.col("parent_source")).alias("__parent"))
    joined = records.withColumn("__name", name).join(F.broadcast(wanted), "__name", "left")
    source = X.normalize(F.col("source"))
    holds = lambda c: F.coalesce((F.col(c) != "") & F.contains(source, F.col(c)), F.lit(False))
    named = (F.coalesce("__official", F.lit("")) != "") | (F.coalesce("__parent", F.lit("")) != "")
    tier = F.when(holds("__official"), 0).when(holds("__parent"), 1).when(~named, 2)
    ranked = joined.withColumn("__tier", tier).filter("__tier is not null")
    best = best_per(ranked, ["__name"], [F.col("__tier"), F.desc("quality")])
    return best.withColumn("official", F.col("__tier") == 0).drop("__name", "__official", "__parent", "__tier")


def fill(candidates: DataFrame, prototypes: list[str], target: int) -> DataFrame:
    """(id, reason, place) of the core set out of candidates (id, name, official_place,
    parent, prototypes, authority, score, quality).

    Official ones come first in their own order, then parents by authority, then for each
    prototype that nobody represents its best candidate, then the best of all.  Only the
    best candidate of each prototype goes through one task, a number the ontology sets."""
    name = X.normalize(F.col("name"))
    order = [F.desc("authority"), F.desc("score"), F.desc("quality.complete"), F.desc("quality.places"), name]
    first = F.when(F.col("official_place").isNotNull(), 0).when(F.col("parent"), 1)
    placed = candidates.withColumn("tier", first)
    held = placed.filter("tier is not null")
    represented = held.select(F.explode("prototypes").alias("prototype")).distinct()
    rest = placed.filter("tier is null")
    spread = rest.withColumn("prototype", F.explode("prototypes")).join(represented, "prototype", "left_anti")
    seeds = best_per(spread, ["prototype"], order).select("id", "prototype", "prototypes")

    def cover(frame: pd.DataFrame) -> pd.DataFrame:
        have, out = set(), []
        rank = {p: i for i, p in enumerate(prototypes)}
        for row in sorted(frame.itertuples(), key=lambda r: rank.get(r.prototype, len(rank))):
            if row.prototype in rank and row.prototype not in have:
                out.append((row.id, rank[row.prototype]))
                have.update(row.prototypes)
        return pd.DataFrame(out, columns=["id", "seed"])

    kind = candidates.schema["id"].dataType.simpleString()
    picked = seeds.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(cover, f"id {kind}, seed int").groupBy("id").agg(F.min("seed").alias("seed"))
    whole = placed.join(picked, "id", "left").withColumn("tier", F.coalesce("tier", F.when(F.col("seed").isNotNull(), 2), F.lit(3)))
    within = [F.col("tier"), F.coalesce("official_place", F.when(F.col("tier") == 2, F.col("seed")), F.lit(0)), *order]
    reason = F.element_at(F.array(*map(F.lit, ("official", "parent", "coverage", "authority"))), F.col("tier") + 1)
    top = whole.orderBy(*within).limit(target)
    return top.select("id", reason.alias("reason"), F.row_number().over(Window.orderBy(*within)).alias("place"))


def status(index: DataFrame, core: DataFrame) -> DataFrame:
    """One row: what an index holds and whether the core set beside it may be used."""
    return index.select("schema_version", "total", "indexed", "excluded").join(F.broadcast(core.select("ready")))  # one row each
