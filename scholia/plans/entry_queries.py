"""Queries over labels, headers, listings, whole volumes and reports on indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import appendix, coreset, entries, search, survey
from ..sources import pages
from .corpus_queries import labelled
from .registry import query, table

#: Labels as OCR gives them: known, spaced, aliases, slightly wrong, and no label at all.
RAW_LABELS = ("组成", "主 治", "主洽", "方论选禄", "现代研充", "怪字", "功效", "附 方")


def _picked(options: tuple[str, ...], number) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


@query("""
WITH k(i, label, method) AS (VALUES (0, '组成', 'exact'), (1, '主治', 'exact'), (2, '主治', 'alias'), (3, '方论选录', 'fuzzy'), (4, '现代研究', 'fuzzy'), (5, NULL, 'unknown'), (6, '功用', 'alias'), (7, '附方', 'exact'))
SELECT p_brand, coalesce(label, '') AS label, method, count(*) AS n FROM part JOIN k ON i = p_size % 8 GROUP BY ALL
""")
def label_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How raw labels were read, by brand."""
    raw = table(spark, sf_dir, "part").select("p_brand", _picked(RAW_LABELS, F.col("p_size")).alias("raw"))
    return entries.labels(raw, "raw").groupBy("p_brand", F.coalesce("label", F.lit("")).alias("label"), "method").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT p_partkey AS k, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['引言', '【组成】' || p_name, '【主治】' || p_brand, '【方源】' || p_type]
  WHEN p_partkey % 3 = 1 THEN ['【主治】' || p_name] ELSE ['无 ' || p_name] END) AS piece, unnest(CASE WHEN p_partkey % 3 = 0 THEN [0, 1, 2, 3] ELSE [0] END) AS place FROM part)
SELECT k AS p_partkey, CAST(place AS INTEGER) AS place, piece FROM p
""")
def embedded_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with several labelled fields, brackets and labels damaged, cut apart."""
    third, name = F.pmod("p_partkey", F.lit(3)), F.col("p_name")
    several = F.concat(F.lit("引言[组成】"), name, F.lit("（主洽)"), F.col("p_brand"), F.lit("〔来源〕"), F.col("p_type"))
    text = F.when(third == 0, several).when(third == 1, F.concat(F.lit("(主冶）"), name)).otherwise(F.concat(F.lit("无 "), name))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(entries.split_fields(text)).alias("place", "piece"))


@query("""
WITH o AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS id, lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS other, o_orderstatus AS s, o_orderkey % 900 + 1 AS page FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 4 < 2 THEN id END AS id, CASE k % 4 WHEN 0 THEN '甲' || s WHEN 1 THEN '甲' || s || '....' || page END AS name,
       CASE WHEN k % 4 = 1 THEN '甲' || s END AS listed, CASE WHEN k % 4 = 1 THEN CAST(page AS INTEGER) END AS page, CASE WHEN k % 4 = 3 THEN id || ',' || other ELSE id END AS ids FROM o
""")
def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, listings, bare numbers and references, their digits damaged."""
    damaged = lambda c: F.translate(F.lpad(F.pmod(c, F.lit(100000)).cast("string"), 5, "0"), "01", "Ol")
    kind, name = F.pmod("o_orderkey", F.lit(4)), F.concat(F.lit("甲"), F.col("o_orderstatus"))
    own, other = damaged(F.col("o_orderkey")), damaged(F.col("o_custkey"))
    page = (F.pmod("o_orderkey", F.lit(900)) + 1).cast("string")
    text = F.when(kind == 0, F.concat_ws(" ", own, name)).when(kind == 1, F.concat(own, F.lit(" "), name, F.lit("...."), page)).when(kind == 2, own)
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(text, F.concat(F.lit("见 "), own, F.lit("，"), other, F.lit(" 号"))).alias("text"))
    header, listed = entries.header_of(F.col("text")), entries.listing_of(F.col("text"))
    return lines.select("o_orderkey", header["id"].alias("id"), header["name"].alias("name"), listed["name"].alias("listed"), listed["page"].alias("page"), F.array_join(entries.index_ids(F.col("text")), ",").alias("ids"))


_VOLUME = """
WITH l AS (SELECT conv_id, turn, role, text, (conv_id * 37 + turn) % 90000 + 1 AS number, (length(text) % 100) / 100.0 AS confidence FROM conversations),
     h AS (SELECT *, role = 'user' AND number <= 80000 AS opens, lpad(CAST(number AS VARCHAR), 5, '0') AS id FROM l),
     e AS (SELECT *, max(CASE WHEN opens THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS entry FROM h),
     f AS (SELECT *, CASE WHEN role = 'assistant' THEN '、' || md5(text) || '、' WHEN role = 'user' THEN id || ' 名' || id || '。' ELSE '杂语' END AS said,
             coalesce(max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id, entry ORDER BY turn), -1) >= 0 AS labelled FROM e WHERE entry IS NOT NULL)
"""


def volume_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as volumes: user turns are headers, assistant turns labelled lines."""
    turns = table(spark, sf_dir, "conversations")
    number = F.pmod(F.col("conv_id") * 37 + F.col("turn"), F.lit(90000)) + 1
    text = F.when(F.col("role") == "user", F.concat(F.lpad(number.cast("string"), 5, "0"), F.lit(" 名"), F.lpad(number.cast("string"), 5, "0"), F.lit("。")))
    labelled = F.concat(F.lit("[主洽】、"), F.md5(F.col("text").cast("binary")), F.lit("、"))
    return turns.select(
        F.col("conv_id").alias("volume"), F.col("turn").alias("pdf_page"), F.lit(0).alias("region_index"), F.lit(0).alias("line_index"), number.alias("number"),
        (F.pmod(F.length("text"), F.lit(100)) / 100).alias("confidence"), F.when(F.col("role") == "assistant", labelled).otherwise(F.coalesce(text, F.lit("杂语"))).alias("text"),
    )


def built_volumes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = volume_lines(spark, sf_dir)
    ids = lines.select("number").distinct().filter("number % 3 > 0").withColumn("id", F.lpad(F.col("number").cast("string"), 5, "0"))
    listing = ids.select("id", F.when(F.col("number") % 3 == 1, F.concat(F.lit("名"), F.col("id"), F.lit("。"))).otherwise("〇〇").alias("name"), F.col("number").cast("int").alias("page"))
    return entries.build_volume(lines.drop("number"), listing, 1, 80000, first_page=1)


@query(_VOLUME + """,
g AS (SELECT conv_id, entry, max(CASE WHEN opens THEN id END) AS id, string_agg(CASE WHEN NOT opens AND NOT labelled THEN said END, '' ORDER BY turn) AS body,
        string_agg(CASE WHEN NOT opens AND labelled THEN said END, '' ORDER BY turn) AS indication, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS minimum, count(*) AS n, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS pages FROM f GROUP BY ALL)
SELECT conv_id AS volume, id, '名' || id || '。' AS name, md5(concat_ws('|', '主治=' || indication, '正文=' || body)) AS fields, mean, minimum, n AS line_count, pages,
       concat_ws(',', CASE WHEN minimum < 0.7 THEN 'low_confidence_line' END, CASE WHEN body IS NULL THEN 'missing_source_field' END,
         CASE CAST(id AS INTEGER) % 3 WHEN 0 THEN 'missing_from_parsed_toc' WHEN 2 THEN 'name_differs_from_toc' END) AS flags FROM g
""")
def volume_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to entries in one job: fields, assembled text, confidence, pages, flags."""
    built, _ = built_volumes(spark, sf_dir)
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    pages = F.array_join(F.col("pages").cast("array<string>"), ",")
    return built.select("volume", "id", "name", F.md5(F.array_join(pairs, "|").cast("binary")).alias("fields"), "mean", "minimum", "line_count", pages.alias("pages"), F.array_join("flags", ",").alias("flags"))


@query(_VOLUME + """
SELECT 'exact' AS method, count(*) AS n FROM f WHERE role = 'assistant' UNION ALL SELECT 'embedded_split', count(*) FROM f WHERE role = 'assistant'
""")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts = built_volumes(spark, sf_dir)
    return counts.groupBy("method").agg(F.sum("n").alias("n"))


@query("""
WITH r AS (SELECT conv_id, turn + 1 AS turn, role FROM conversations), c AS (SELECT conv_id, turn, role FROM conversations)
SELECT 'exact' AS rule, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.turn = r.turn AND c.role = r.role)
UNION ALL SELECT 'loose', count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.turn = r.turn)
UNION ALL SELECT 'colliding', (SELECT count(*) FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_partkey = 2 * a.p_partkey))
""")
def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction rules that meet no line, on all keys and on fewer, and placeholders for
    ids that are taken."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    rules = lines.withColumn("turn", F.col("turn") + 1)
    both = rules.withColumn("rule", F.lit("exact")).unionByName(rules.withColumn("role", F.lit(None).cast("string")).withColumn("rule", F.lit("loose")))
    missed = entries.unmatched_rules(both, lines, ["conv_id", "turn", "role"], ["conv_id", "turn"])
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    taken = entries.colliding(part.select((F.col("id") * 2).alias("id")), part).agg(F.count("*").alias("n")).select(F.lit("colliding").alias("rule"), "n")
    every = spark.createDataFrame([("exact",), ("loose",)], "rule string").join(missed.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left")
    return every.select("rule", F.coalesce("n", F.lit(0)).alias("n")).unionByName(taken)


@query("""
WITH r AS (SELECT l_partkey AS id, round(1 - l_discount * 5, 4) AS similarity, l_returnflag AS section FROM lineitem WHERE l_partkey % 7 > 0),
     i AS (SELECT id, count(*) AS n, max(similarity) AS best FROM r GROUP BY id)
SELECT 'rows' AS fact, CAST(sum(n) AS BIGINT) AS n FROM i UNION ALL SELECT 'unique_ids', count(*) FROM i UNION ALL SELECT 'duplicate_ids', count(*) FROM i WHERE n > 1
UNION ALL SELECT 'low_similarity', count(*) FROM i WHERE best < 0.7 UNION ALL SELECT 'missing_ids', count(*) FROM part WHERE p_partkey NOT IN (SELECT id FROM i)
UNION ALL SELECT 'section ' || section, count(*) FROM r GROUP BY section
""")
def index_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_partkey % 7 > 0")
    rows = lines.select(F.col("l_partkey").alias("id"), F.round(1 - F.col("l_discount") * 5, 4).alias("similarity"), F.col("l_returnflag").alias("section"))
    report = entries.index_report(rows, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))
    facts = report.unpivot([], ["rows", "unique_ids", "duplicate_ids", "low_similarity", "missing_ids"], "fact", "n")
    return facts.unionByName(entries.section_counts(rows).select(F.concat(F.lit("section "), F.col("section")).alias("fact"), "n"))


@query("""
SELECT doc_id, source AS source_text, concat_ws(chr(10), nullif(trim(lang), ''), CASE WHEN n_chars % 2 = 0 THEN '制' END) AS usage_text,
       CASE WHEN n_chars % 3 = 0 THEN '加' ELSE '' END AS modifications, md5(trim(split_part(text, chr(10), 1))) AS indications,
       '正文：' || source || chr(10) || '备考：' || lang || CASE WHEN n_chars % 2 = 1 THEN chr(10) || '杂：' || source ELSE '' END AS other_text FROM documents
""")
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index columns out of maps of fields, with what no column takes."""
    odd = F.pmod("n_chars", F.lit(2)) == 1
    fields = F.create_map(
        F.lit("杂"), F.when(odd, F.col("source")).otherwise(""), F.lit("备考"), F.col("lang"), F.lit("方源"), F.col("source"), F.lit("用法"), F.col("lang"), F.lit("制法"), F.when(odd, " ").otherwise("制"),
        F.lit("加减"), F.when(F.pmod("n_chars", F.lit(3)) == 0, "加").otherwise(""), F.lit("附方"), F.lit(None).cast("string"), F.lit("主治"), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("正文"), F.col("source"),
    )
    rows = table(spark, sf_dir, "documents").withColumn("fields", fields)
    made = rows.select("doc_id", *(c.alias(n) for n, c in entries.index_record(F.col("fields")).items()))
    return made.select("doc_id", "source_text", "usage_text", "modifications", F.md5(F.col("indications").cast("binary")).alias("indications"), "other_text")


@query("""
WITH c AS (SELECT p_partkey, p_name, p_brand AS primary_id, p_type, p_retailprice > 1500 AS official FROM part WHERE p_size > 25)
SELECT 'entries' AS fact, count(*) AS n FROM c UNION ALL SELECT 'represented', count(DISTINCT x) FROM (SELECT primary_id AS x FROM c UNION SELECT p_type FROM c)
UNION ALL SELECT 'primary_represented', count(DISTINCT primary_id) FROM c UNION ALL SELECT 'official', count(*) FROM c WHERE official
UNION ALL SELECT 'size_ok', (count(*) BETWEEN 300 AND 500)::INT FROM c UNION ALL SELECT 'ids_ok', (count(DISTINCT p_partkey) = count(*))::INT FROM c
UNION ALL SELECT 'names_ok', (count(DISTINCT p_name) = count(*))::INT FROM c UNION ALL SELECT 'prototypes_ok', (count(*) FILTER (p_type NOT IN ('ECONOMY', 'STANDARD')) = 0)::INT FROM c
UNION ALL SELECT 'primary ' || primary_id, count(*) FROM c GROUP BY primary_id
""")
def core_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, distribution and readiness of a core set."""
    part = table(spark, sf_dir, "part")
    chosen = part.filter("p_size > 25").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("primary"), F.array("p_brand", "p_type").alias("prototypes"), F.when(F.col("p_retailprice") > 1500, "official").otherwise("ranking").alias("source")
    )
    known = ["ECONOMY", "STANDARD", *(f"Brand#{i}{j}" for i in range(1, 10) for j in range(1, 10))]
    summed = entries.core_summary(chosen, 62).unpivot([], ["entries", "represented", "primary_represented", "official"], "fact", "n")
    checks = entries.core_ready(chosen, known, "a", "a").select(*(F.col(c).cast("long").alias(c) for c in ("size_ok", "ids_ok", "names_ok", "prototypes_ok")))
    spread = entries.primary_distribution(chosen).select(F.concat(F.lit("primary "), F.col("primary")).alias("fact"), "n")
    return summed.unionByName(checks.unpivot([], checks.columns, "fact", "n")).unionByName(spread)


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '主治病证索引' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '画' WHEN 3 THEN '第' || p_size || '总' ELSE p_name END AS text FROM part)
SELECT 'appendix_header' AS rule, count(*) AS n FROM t WHERE p_partkey % 5 < 4
UNION ALL SELECT 'disputed', count(*) FROM part WHERE p_size % 4 > 0 AND (p_size % 3 = 0 OR p_size % 2 = 0)
UNION ALL SELECT 'book_pages', CAST(sum(2 * p_size - 19) AS BIGINT) FROM part
""")
def audit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running headers of an appendix, disputed names, and pages of the book."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    kind = F.pmod("p_partkey", F.lit(5))
    text = F.when(kind == 0, "主治病证索引").when(kind == 1, size.cast("string")).when(kind == 2, "画").when(kind == 3, F.concat(F.lit("第"), size.cast("string"), F.lit("总"))).otherwise(F.col("p_name"))
    listed = F.when(F.pmod(size, F.lit(4)) > 0, F.col("p_name"))
    flags = F.when(F.pmod(size, F.lit(3)) == 0, F.array(F.lit("name_differs_from_toc"))).otherwise(F.array().cast("array<string>"))
    pages = F.aggregate(entries.book_pages(F.array(size, size + 1), 11), F.lit(0), lambda a, p: a + p)
    counted = part.agg(
        F.count_if(entries.appendix_header(text)).alias("appendix_header"), F.count_if(entries.disputed(listed, flags, F.pmod(size, F.lit(2)) == 0)).alias("disputed"), F.sum(pages).alias("book_pages")
    )
    return counted.unpivot([], counted.columns, "rule", "n")


_INDEX = """
WITH c AS (SELECT p_partkey AS seq, lpad(CAST(p_partkey * 3 % 100000 AS VARCHAR), 5, '0') AS id, chr(CAST(19968 + p_partkey % 500 AS INTEGER)) AS name FROM part),
     r AS (SELECT seq, name, CASE seq % 4 WHEN 0 THEN id WHEN 1 THEN substr(id, 1, 4) WHEN 2 THEN substr(id, 1, 2) || '9' || substr(id, 4, 2) ELSE id || '7' END AS digits FROM c),
     d AS (SELECT r.seq, r.digits, c.id, least(levenshtein(r.digits, c.id), CASE WHEN length(r.digits) < 5 THEN levenshtein(lpad(r.digits, 5, '0'), c.id) ELSE 99 END) AS distance FROM r JOIN c USING (name)),
     k AS (SELECT *, id = lpad(digits, 5, '0') AND length(digits) <= 5 AS own FROM d WHERE distance <= 3),
     o AS (SELECT *, lead(distance) OVER w AS next, row_number() OVER w AS place, EXISTS (SELECT 1 FROM c WHERE c.id = lpad(k.digits, 5, '0') AND length(k.digits) <= 5) AS has FROM k WINDOW w AS (PARTITION BY seq ORDER BY own DESC, distance, id))
"""


@query(_INDEX + """
SELECT r.seq, CASE WHEN own OR has OR next IS DISTINCT FROM distance THEN id END AS id, CASE WHEN o.seq IS NULL THEN 'invalid_id_or_name' WHEN own OR has OR next IS DISTINCT FROM distance THEN 'ok' ELSE 'ambiguous_repair' END AS reason
FROM r LEFT JOIN o ON o.seq = r.seq AND place = 1
""")
def index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows with damaged ids matched to entries; names are single signs, so that
    similarity is one or nothing."""
    rows, canonical = damaged_index(spark, sf_dir)
    good, bad = appendix.matched(rows, canonical)
    return good.select("seq", "id", F.lit("ok").alias("reason")).unionByName(bad.select("seq", F.lit(None).cast("string").alias("id"), "reason"))


def damaged_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.decode(F.unhex(F.hex((19968 + key % 500).cast("int"))), "UTF-16BE")
    own = F.lpad((key * 3 % 100000).cast("string"), 5, "0")
    kind = key % 4
    raw = F.when(kind == 0, own).when(kind == 1, F.substring(own, 1, 4)).when(kind == 2, F.concat(F.substring(own, 1, 2), F.lit("9"), F.substring(own, 4, 2))).otherwise(F.concat(own, F.lit("7")))
    canonical = part.select(own.alias("id"), name.alias("name"))
    return part.select(key.alias("seq"), F.translate(raw, "01", "QI").alias("raw_id"), name.alias("name"), F.lit(0.9).alias("confidence")), canonical


@query("""
WITH j AS (SELECT o_orderpriority AS major, o_orderstatus AS minor, o_orderkey, l_partkey, l_linenumber, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
     f AS (SELECT major, minor, l_partkey, min(o_orderkey) AS o FROM j GROUP BY ALL)
SELECT major, minor, count(*) AS n_ids, min(l_partkey) AS least, (SELECT count(DISTINCT l_suppkey) FROM j WHERE j.major = f.major AND j.minor = f.minor) AS n_pages,
       md5(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY o, l_partkey)) AS ids FROM f GROUP BY ALL
""")
def term_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms (priority and status of orders) that are listed again and again, merged."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("ids"), F.collect_set("l_suppkey").alias("pages"))
    rows = lines.join(table(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderpriority").alias("major"), F.col("o_orderstatus").alias("minor"), "o_orderkey", "ids", "pages")
    merged = appendix.merged_terms(rows, ["major", "minor"], "o_orderkey", "ids", "pages")
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return merged.select("major", "minor", F.col("n_ids").cast("long").alias("n_ids"), F.array_min("ids").alias("least"), F.size("pages").cast("long").alias("n_pages"), F.md5(text.cast("binary")).alias("ids"))


@query("""
WITH r AS (SELECT p_partkey, p_name || ' ' || CASE p_size % 5 WHEN 0 THEN '《方剂学》' WHEN 1 THEN '《中国药典》《甲乙》' WHEN 2 THEN '《甲乙》《丙丁》《甲乙》' ELSE '' END AS actions, CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '忌' END AS cautions, CASE p_size % 3 WHEN 0 THEN '方论选录：' WHEN 1 THEN '临证举例：' ELSE '' END AS other FROM part)
SELECT p_partkey, contains(actions, '方剂学')::INT AS textbook, contains(actions, '药典')::INT AS standard, CAST(len(list_distinct(regexp_extract_all(actions, '《([^》]{2,40})》', 1))) AS INTEGER) AS works,
       contains(other, '方论')::INT AS commentary, (trim(cautions) <> '')::INT AS cautions, contains(other, '临证')::INT AS cases FROM r
""")
def core_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six facts that speak for a record's authority."""
    size = F.col("p_size")
    cited = F.when(size % 5 == 0, "《方剂学》").when(size % 5 == 1, "《中国药典》《甲乙》").when(size % 5 == 2, "《甲乙》《丙丁》《甲乙》").otherwise("")
    other = F.when(size % 3 == 0, "方论选录：").when(size % 3 == 1, "临证举例：").otherwise("")
    facts = coreset.authority(F.concat_ws(" ", "p_name", cited), F.lit(""), F.when(size % 2 == 0, " ").otherwise("忌"), other)
    return table(spark, sf_dir, "part").select("p_partkey", facts.alias("f")).select("p_partkey", "f.*")


_CORE = """
WITH r AS (SELECT p_partkey AS id, p_name AS name, p_brand || ' ' || p_type AS source, p_size, p_retailprice, p_type, p_brand FROM part
           WHERE p_size > 5 AND p_size % 9 > 0 AND NOT regexp_matches(p_brand, '9')),
     x AS (SELECT p_name AS name, CASE WHEN length(p_name) % 3 = 0 THEN 'brand#1' ELSE '' END AS official, CASE WHEN length(p_name) % 3 < 2 THEN 'brand#2' ELSE '' END AS parent FROM (SELECT DISTINCT p_name FROM part)),
     t AS (SELECT r.*, CASE WHEN official <> '' AND contains(lower(source), official) THEN 0 WHEN parent <> '' AND contains(lower(source), parent) THEN 1 WHEN official = '' AND parent = '' THEN 2 END AS tier FROM r JOIN x USING (name)),
     c AS (SELECT * FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, (p_size > 20) DESC, length(CAST(id AS VARCHAR)), CAST(id AS VARCHAR) DESC) = 1)
"""


def core_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    size, name = F.col("p_size"), F.col("p_name")
    fact = F.when(size % 9 > 0, name).otherwise(" ")
    key = F.col("p_partkey").cast("string")
    pages = F.array("p_size")
    flags = F.when(size > 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("low_confidence_line")))
    source = F.concat_ws(" ", F.regexp_replace("p_brand", "9", "医院"), "p_type")
    kept = part.filter(coreset.admitted([name, fact], F.lit(1), [pages, pages], flags, name, source))
    quality = coreset.record_quality([name, F.when(size > 20, name)], [pages, pages], key)
    records = kept.select(F.col("p_partkey").alias("id"), name.alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("source"), quality.alias("quality"), "p_size", "p_retailprice", "p_type", "p_brand")
    third = F.length("p_name") % 3
    expected = part.select(name.alias("name"), F.when(third == 0, "Brand#1").otherwise("").alias("official_source"), F.when(third < 2, "Brand#2").otherwise("").alias("parent_source")).distinct()
    return coreset.chosen_records(records, expected)


@query(_CORE + "SELECT id, name, tier = 0 AS official FROM c")
def core_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each name, from the source that is expected."""
    return core_candidates(spark, sf_dir).select("id", "name", "official")


@query(_CORE + """,
k AS (SELECT *, CASE WHEN tier = 0 THEN 0 WHEN p_size % 7 = 0 THEN 1 END AS held, [p_type, p_brand] AS ps, p_size % 4 AS authority, p_size AS score, 1 + (p_size > 20)::INT AS complete FROM c),
rep AS (SELECT DISTINCT unnest(ps) AS p FROM k WHERE held IS NOT NULL),
sd AS (SELECT p, id, ps FROM (SELECT id, ps, authority, score, complete, name, unnest(ps) AS p FROM k WHERE held IS NULL) WHERE p NOT IN (SELECT p FROM rep) QUALIFY row_number() OVER (PARTITION BY p ORDER BY authority DESC, score DESC, complete DESC, lower(name)) = 1),
ty AS (SELECT id, ps FROM sd WHERE p NOT LIKE 'Brand%'),
se AS (SELECT id FROM ty UNION SELECT id FROM sd WHERE p LIKE 'Brand%' AND p NOT IN (SELECT unnest(ps) FROM ty)),
o AS (SELECT id, CASE WHEN held IS NOT NULL THEN held WHEN id IN (SELECT id FROM se) THEN 2 ELSE 3 END AS tier, authority, score, complete, name FROM k),
z AS (SELECT id, tier, row_number() OVER (ORDER BY tier, CASE WHEN tier = 0 THEN id ELSE 0 END, authority DESC, score DESC, complete DESC, lower(name)) AS place FROM o WHERE tier <> 2)
SELECT tier, count(*) AS n, coalesce(md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY place)), '') AS ids FROM z GROUP BY tier
UNION ALL SELECT 2, count(*), md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) FROM o WHERE tier = 2 HAVING count(*) > 0
""")
def core_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a core set fills up: official, parents, coverage, authority."""
    rows = core_candidates(spark, sf_dir)
    kinds = sorted(r[0] for r in table(spark, sf_dir, "part").select("p_type").distinct().collect())  # the ontology: types, then brands
    brands = sorted(r[0] for r in table(spark, sf_dir, "part").select("p_brand").distinct().collect())
    candidates = rows.select(
        "id", "name", F.when(F.col("official"), F.col("id")).alias("official_place"), (F.col("p_size") % 7 == 0).alias("parent"), F.array("p_type", "p_brand").alias("prototypes"),
        (F.col("p_size") % 4).alias("authority"), F.col("p_size").alias("score"), "quality",
    )
    filled = coreset.fill(candidates, [*kinds, *brands], 1_000_000)
    tier = F.array_position(F.array(*map(F.lit, ("official", "parent", "coverage", "authority"))), F.col("reason")).cast("int") - 1
    ordered = F.array_sort(F.collect_list(F.struct(F.when(tier == 2, F.col("id")).otherwise(F.col("place")).alias("p"), "id")))
    gathered = filled.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), ordered.alias("l"))
    return gathered.select("tier", "n", F.md5(F.array_join(F.transform("l", lambda x: x["id"].cast("string")), ",").cast("binary")).alias("ids"))


@query("""
SELECT doc_id, md5(CASE WHEN length(text) > 600 THEN rtrim(substr(text, 1, 600)) || '……' ELSE text END) AS shown, CASE WHEN length(text) > 600 THEN '方源' ELSE '' END AS cut, md5(text) AS whole,
       '《中医方剂大辞典》' || CASE WHEN n_chars % 3 > 0 THEN '第' || n_chars % 3 || '册' ELSE '' END || CASE WHEN n_chars % 2 = 0 THEN '，PDF第' || n_chars || '、1页' ELSE '' END || '，书内第2页' AS citation
FROM documents WHERE text <> ''
""")
def shown_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as they are shown: fields cut to their limits, labels of those, citation."""
    n = F.col("n_chars")
    fields = F.create_map(F.lit("方源"), F.col("text"), F.lit("功用"), F.col("lang"), F.lit("主治"), F.lit(""))
    cut, labels = search.shown_fields(fields)
    whole, _ = search.shown_fields(fields, full=True)
    pages = F.when(n % 2 == 0, F.array(n, F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    md5 = lambda m: F.md5(F.element_at(m, F.lit("方源")).cast("binary"))
    return table(spark, sf_dir, "documents").filter("text <> ''").select(
        "doc_id", md5(cut).alias("shown"), F.array_join(labels, ",").alias("cut"), md5(whole).alias("whole"), search.citation(n % 3, pages, F.array(F.lit(2))).alias("citation")
    )


@query("""
WITH e AS (SELECT doc_id, source, n_chars, CASE WHEN toxic = 1 THEN 'source_page_missing' WHEN quality = 0 THEN 'partial_source_page_missing' ELSE 'complete' END AS status FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'status ' || status AS fact, count(*) AS n FROM e WHERE status <> 'complete' GROUP BY status
UNION ALL SELECT 'blank pages', count(*) FROM (SELECT DISTINCT source, unnest([n_chars % 40, n_chars % 7]) FROM e WHERE status = 'source_page_missing')
""")
def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries kept out of the corpus by status, and the blank pages behind them."""
    status = F.when(F.col("toxic") == 1, "source_page_missing").when(F.col("quality") == 0, "partial_source_page_missing").otherwise("complete")
    rows = labelled(spark, sf_dir).select(F.col("source").alias("volume"), status.alias("record_status"), F.array(F.col("n_chars") % 40, F.col("n_chars") % 7).alias("pdf_pages"))
    by_status, blank = pages.excluded(rows)
    counted = blank.agg(F.count("*").alias("n")).select(F.lit("blank pages").alias("fact"), "n")
    return by_status.select(F.concat(F.lit("status "), F.col("record_status")).alias("fact"), "n").unionByName(counted)


@query("""
WITH n AS (SELECT n_nationkey + 1 AS id, n_regionkey * 5 AS parent_id, n_nationkey % 6 = 5 AS none FROM nation),
     p AS (SELECT a.id AS none_id, b.id FROM n a JOIN n b ON b.id > a.parent_id AND b.id < a.id WHERE a.none),
     c AS (SELECT none_id AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS clear_ids FROM p GROUP BY none_id)
SELECT * FROM c UNION ALL SELECT id, CAST(max(none_id) AS VARCHAR) FROM p WHERE id NOT IN (SELECT id FROM c) GROUP BY id
""")
def exclusion_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that a "nothing of this" option clears, and that clear it."""
    title = F.when(F.col("n_nationkey") % 6 == 5, "没有变化").otherwise(F.col("n_name"))
    nodes = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("id"), (F.col("n_regionkey") * 5).alias("parent_id"), title.alias("title"))
    return survey.between_exclusions(nodes, ("没有变化",)).select("id", F.array_join(F.col("clear_ids").cast("array<string>"), ",").alias("clear_ids"))


@query("""
SELECT a.n_nationkey AS id, coalesce((SELECT string_agg(CAST(b.n_nationkey AS VARCHAR), ',' ORDER BY b.n_nationkey) FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey % 3 <> a.n_nationkey % 3), '') AS clear_ids FROM nation a
""")
def exclusion_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of all other branches below the same parent."""
    rows = table(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey") % 3).alias("branch"), F.col("n_nationkey").alias("id"))
    return survey.sibling_exclusions(rows, "n_regionkey", "branch", "id").select("id", F.array_join(F.col("clear_ids").cast("array<string>"), ",").alias("clear_ids"))
