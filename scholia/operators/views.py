"""What a reader of records sees: lists, histories, evidence, drafts, the finished record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a finished record and what stands for a missing fact.
EXAMINED = (("inspection", "望诊"), ("listening", "闻诊"), ("palpation", "切诊"))
ANALYSED = (
    ("cause", "病因"), ("location", "病位"), ("nature", "病性"), ("trend", "病势"), ("mechanism", "病机"),
    ("syndrome", "证型"), ("principle", "治则"), ("treatment", "治法"), ("evidence", "辨证依据"),
)
NOT_GIVEN, TO_ADD = "待填 / 未提供", "待医师补充"


def said(value: Column) -> Column:
    """The value, null where it is blank."""
    return F.nullif(value, F.lit(""))


def visit_view(visits: DataFrame, kinds: dict[str, str], asked: str, kind: str, date: str, place: str, default: str) -> DataFrame:
    """Visits with their kind's label, the day alone, and the place blanked where the kind
    is not the one asked for."""
    code = F.coalesce(said(F.col(kind)), F.lit(default))
    names = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    shown = visits.withColumn(place, F.when(code == asked, F.col(place)).otherwise(""))
    return shown.withColumn("kind_label", F.coalesce(F.element_at(names, code), F.lit(""))).withColumn(date, F.to_date(date))


def owner_names(rows: DataFrame, owners: DataFrame, key: str, owner: str, name: str) -> DataFrame:
    """``rows`` with the owner's name, '' where there is none."""
    return rows.join(owners.select(F.col(owner).alias(key), F.col(name).alias("owner_name")), key, "left").withColumn("owner_name", F.coalesce("owner_name", F.lit("")))


def latest_listing(rows: DataFrame, order: list[Column], n: int = 100) -> DataFrame:
    """The first ``n`` in a stated order (a top-k, so nothing is sorted but them)."""
    return rows.orderBy(*order).limit(n)


def with_default_rows(rows: DataFrame, parents: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """History rows and, for each parent, one row of defaults that is not stored."""
    kinds = {f.name: f.dataType for f in rows.schema}
    fresh = parents.select(F.col(key), *(F.lit(defaults.get(c)).cast(kinds[c]).alias(c) for c in rows.columns if c != key))
    return rows.withColumn("stored", F.lit(True)).unionByName(fresh.withColumn("stored", F.lit(False)))


def messages_view(rows: DataFrame, messages: str, edited: str, output: str) -> DataFrame:
    """System and user prompts out of a JSON list of messages; an edit that equals the
    output is none."""
    parsed = F.from_json(messages, "array<struct<role:string,content:string>>")
    edit = F.coalesce(F.col(edited), F.lit(""))
    shown = rows.withColumn("__m", parsed).withColumn("system", F.get("__m", F.lit(0))["content"]).withColumn("user", F.get("__m", F.lit(1))["content"])
    return shown.withColumn(edited, F.when(edit == F.col(output), "").otherwise(edit)).drop("__m")


def supports(found: list[Column], reasons: Column, most: int = 9, instead: int = 4) -> Column:
    """Evidence from several lists, each piece once, or else the first reasons."""
    pieces = F.filter(F.concat(*(F.coalesce(f, F.array().cast("array<string>")) for f in found)), lambda x: F.coalesce(x, F.lit("")) != "")
    once = F.slice(F.array_distinct(pieces), 1, most)
    return F.when(F.size(once) > 0, once).otherwise(F.slice(reasons, 1, instead))


def summary(action: Column, indication: Column, most: int = 90) -> Column:
    cut = F.when(F.length(indication) > most, F.concat(F.substring(indication, 1, most), F.lit("…"))).otherwise(indication)
    return F.coalesce(said(action), cut)


def draft(composition: Column, usage: Column) -> Column:
    """Composition and usage as a draft; '' without a composition."""
    have = said(F.trim(F.coalesce(composition, F.lit(""))))
    return F.when(have.isNotNull(), F.concat_ws("\n\n", have, said(F.trim(F.coalesce(usage, F.lit("")))))).otherwise("")


def joined_drafts(rows: DataFrame, group: list[str], order: str, name: str, text: str) -> DataFrame:
    """The drafts of each group under their headings, in order."""
    part = F.concat(F.lit("【"), F.col(name), F.lit(" · 原方参考】\n"), F.col(text))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("draft"))


def unit_text(line: Column, unit: str = "克") -> Column:
    """``name number name number`` as ``name:number克;name:number克。``"""
    pairs = F.transform(
        F.regexp_extract_all(line, F.lit(r"(.*?[\d.]+)"), F.lit(1)),
        lambda p: F.concat(F.trim(F.regexp_extract(p, r"^(.*?)([\d.]+)$", 1)), F.lit(":"), F.regexp_extract(p, r"^(.*?)([\d.]+)$", 2), F.lit(unit)),
    )
    return F.concat(F.array_join(pairs, ";"), F.lit("。"))


def record_text(patient: Column, examined: Column, analysed: Column, chosen: Column, prescription: Column, visit_time: Column, doctor: Column) -> Column:
    """A confirmed record in full; facts that were not given say so.

    ``chosen`` is an array of struct(name, volume, pdf_pages, book_pages, family,
    consistency), ``prescription`` a struct(text, items, count, usage, advice, note) of
    which text or items are null."""
    line = lambda label, value, blank: F.concat(F.lit(label + "："), F.coalesce(said(value), F.lit(blank)))
    pages = lambda p: F.concat(F.lit("["), F.array_join(p.cast("array<string>"), ", "), F.lit("]"))

    def source(c: Column) -> Column:
        place = F.concat(F.lit("辞典依据：第"), c["volume"].cast("string"), F.lit("册，PDF页"), pages(c["pdf_pages"]), F.lit("，书内页"), pages(c["book_pages"]))
        family = F.concat(F.lit("治疗原型："), said(c["family"]))
        return F.array_compact(F.array(F.concat(F.lit("参考基础方："), c["name"]), place, family, F.concat(F.lit("方证反向核验："), said(c["consistency"]))))

    items = F.transform(prescription["items"], lambda i: F.concat_ws(" ", i["herb"], i["dose"], i["note"]))
    listed = F.array(
        F.concat(F.lit("处方："), F.array_join(items, "；")),
        F.concat(F.lit("剂数："), prescription["count"].cast("string"), F.lit("；煎服方法："), prescription["usage"]),
        line("医嘱", prescription["advice"], "待填"),
        line("医师加减说明", prescription["note"], "未另行填写"),
    )
    written = F.array(F.concat(F.lit("处方（医师确认）：\n"), prescription["text"]))
    parts = F.concat(
        F.array(
            F.concat(F.lit("患者："), patient["name"], F.lit("　性别："), patient["sex"], F.lit("　年龄："), patient["age"].cast("string")),
            F.concat(F.lit("药物过敏史："), patient["allergy"]),
            F.concat(F.lit("主诉、现病史及既往史（已确认问诊记录）：\n"), examined["inquiry"]),
            *(line(label, examined[key], NOT_GIVEN) for key, label in EXAMINED),
            *(line(label, analysed[key], TO_ADD) for key, label in ANALYSED),
        ),
        F.flatten(F.transform(chosen, source)),
        F.when(prescription["text"].isNotNull(), written).otherwise(listed),
        F.array(F.lit(f"体格检查、生命体征：{NOT_GIVEN}"), F.lit(f"辅助检查：{NOT_GIVEN}"), F.lit("疾病诊断：待医师填写"), F.concat(F.lit("就诊时间："), visit_time), F.concat(F.lit("医师："), doctor)),
    )
    return F.array_join(parts, "\n\n")
