"""Queries over what readers of records see, and over the question bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import doses, questions, views
from .registry import query, table


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE '' END AS kind_label, CAST(o_orderdate AS DATE) AS o_orderdate,
       CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS o_orderpriority, coalesce(c_name, '') AS owner_name
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey
""")
def visit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits as a list shows them, with their owners."""
    shown = views.visit_view(table(spark, sf_dir, "orders"), {"O": "open", "F": "closed"}, "F", "o_orderstatus", "o_orderdate", "o_orderpriority", "O")
    named = views.owner_names(shown, table(spark, sf_dir, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey", "c_name")
    return named.select("o_orderkey", "kind_label", "o_orderdate", "o_orderpriority", "owner_name")


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus AS star, true AS stored FROM orders UNION ALL SELECT c_custkey, NULL, '-1', false FROM customer
""")
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored revisions, and one of defaults for every record."""
    stored = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("star"))
    return views.with_default_rows(stored, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", {"star": "-1"})


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def latest_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest hundred (the listing operator)."""
    return views.latest_listing(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""
SELECT a.conv_id, a.turn, md5(a.text) AS system, md5(b.text) AS "user", CASE WHEN a.turn % 2 = 0 THEN '' ELSE a.role END AS edited
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
""")
def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts out of stored messages; edits that change nothing are not shown."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    stored = turns.join(after, ["conv_id", "turn"]).withColumn("messages", F.to_json(F.array(message("system", "text"), message("user", "answer"))))
    stored = stored.withColumn("edited", F.col("role")).withColumn("output", F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("x"))
    shown = views.messages_view(stored, "messages", "edited", "output")
    return shown.select("conv_id", "turn", F.md5(F.col("system").cast("binary")).alias("system"), F.md5(F.col("user").cast("binary")).alias("user"), "edited")


@query("""
WITH w AS (SELECT doc_id, source, text, lang, string_split(text, ' ') AS a FROM documents),
     s AS (SELECT *, list_filter(a[1:6] || [source] || a[4:12], lambda x: x <> '') AS l FROM w),
     o AS (SELECT *, CASE WHEN lang = 'de' THEN [] ELSE list_filter(l, lambda x, i: list_position(l, x) = i)[1:9] END AS once FROM s)
SELECT doc_id, md5(array_to_string(CASE WHEN len(once) > 0 THEN once ELSE a[1:4] END, '|')) AS supports,
       md5(CASE WHEN lang <> 'en' THEN source WHEN length(text) > 90 THEN substr(text, 1, 90) || '…' ELSE text END) AS summary FROM o
""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for an entry, each piece once, and its summary."""
    words = F.split("text", " ")
    german = F.col("lang") == "de"
    none = F.array().cast("array<string>")
    found = [F.when(german, none).otherwise(x) for x in (F.slice(words, 1, 6), F.array("source"), F.slice(words, 4, 9))]
    shown = views.supports(found, words)
    brief = views.summary(F.when(F.col("lang") == "en", "").otherwise(F.col("source")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(shown, "|").cast("binary")).alias("supports"), F.md5(brief.cast("binary")).alias("summary"))


@query("""
WITH d AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE chr(10) || chr(10) || p_type END END AS draft FROM part)
SELECT p_brand, md5(string_agg('【' || p_name || ' · 原方参考】' || chr(10) || draft, chr(10) || chr(10) ORDER BY p_partkey)) AS draft, count(*) FILTER (draft = '') AS empty FROM d GROUP BY p_brand
""")
def draft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts out of composition and usage, joined under their sources."""
    size = F.col("p_size")
    made = views.draft(F.when(size % 5 == 0, " ").otherwise(F.col("p_name")), F.when(size % 3 == 0, F.lit(None)).otherwise(F.col("p_type")))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", made.alias("text"))
    empty = rows.groupBy("p_brand").agg(F.count_if(F.col("text") == "").alias("empty"))
    joined = views.joined_drafts(rows, ["p_brand"], "p_partkey", "p_name", "text").join(empty, "p_brand")
    return joined.select("p_brand", F.md5(F.col("draft").cast("binary")).alias("draft"), "empty")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '甲' || l_returnflag || ':' || CAST(l_quantity AS INTEGER) || '克;乙 丙:0.' || l_linenumber || '克。' AS line FROM lineitem
""")
def unit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and numbers as a line with units."""
    raw = F.concat(F.lit(" 甲"), F.col("l_returnflag"), F.col("l_quantity").cast("int").cast("string"), F.lit("  乙 丙0."), F.col("l_linenumber").cast("string"), F.lit(" 丁"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", views.unit_text(raw).alias("line"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus AS s, c_name, o_orderpriority AS p, CAST(o_custkey AS VARCHAR) AS age, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE c_mktsegment END AS half, o_orderkey % 3 = 0 AS listed
           FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, md5(array_to_string([
  '患者：' || c_name || '　性别：' || s || '　年龄：' || age, '药物过敏史：' || p, '主诉、现病史及既往史（已确认问诊记录）：' || chr(10) || p,
  '望诊：' || coalesce(nullif(half, ''), '待填 / 未提供'), '闻诊：待填 / 未提供', '切诊：' || s, '病因：' || coalesce(nullif(half, ''), '待医师补充'), '病位：' || s, '病性：待医师补充', '病势：待医师补充', '病机：' || p, '证型：待医师补充', '治则：待医师补充', '治法：' || s, '辨证依据：待医师补充',
  '参考基础方：' || p, '辞典依据：第3册，PDF页[1, 2]，书内页[5]', '治疗原型：' || s]
  || CASE WHEN listed THEN ['处方：' || p || ' 一两 ' || s || '；乙 二钱 ', '剂数：3；煎服方法：' || s, '医嘱：待填', '医师加减说明：' || coalesce(nullif(half, ''), '未另行填写')] ELSE ['处方（医师确认）：' || chr(10) || p] END
  || ['体格检查、生命体征：待填 / 未提供', '辅助检查：待填 / 未提供', '疾病诊断：待医师填写', '就诊时间：' || s, '医师：' || c_name], chr(10) || chr(10))) AS record FROM r
""")
def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed records in full, with what was not given."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status, priority, name = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("c_name")
    half = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    struct = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    blank, nothing = F.lit(""), F.lit(None).cast("string")
    listed = F.col("o_orderkey") % 3 == 0
    item = lambda h, d, n: struct(herb=h, dose=F.lit(d), note=n)
    text = views.record_text(
        struct(name=name, sex=status, age=F.col("o_custkey"), allergy=priority),
        struct(inquiry=priority, inspection=half, listening=nothing, palpation=status),
        struct(cause=half, location=status, nature=blank, trend=nothing, mechanism=priority, syndrome=blank, principle=nothing, treatment=status, evidence=blank),
        F.array(struct(name=priority, volume=F.lit(3), pdf_pages=F.array(F.lit(1), F.lit(2)), book_pages=F.array(F.lit(5)), family=status, consistency=blank)),
        struct(text=F.when(~listed, priority), items=F.array(item(priority, "一两", status), item(F.lit("乙"), "二钱", blank)), count=F.lit(3), usage=status, advice=blank, note=half),
        status,
        name,
    )
    return rows.select("o_orderkey", F.md5(text.cast("binary")).alias("record"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a bank of headings, screens and options."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    title = F.concat_ws(" ", F.concat_ws(".", F.lit("1"), F.col("n_regionkey"), F.col("n_nationkey")), F.col("n_name"))
    parts = [
        region.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("title"), F.lit(0).alias("level"), F.col("r_regionkey").cast("long").alias("ord"), F.lit(-1).alias("mode")),
        nation.select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), title.alias("title"), F.lit(1).alias("level"), (100 - F.col("n_nationkey")).cast("long").alias("ord"), F.when(F.col("n_nationkey") % 2 == 0, -1).otherwise(0).alias("mode")),
        customer.select((F.col("c_custkey") + 1000).alias("id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.col("c_name").alias("title"), F.lit(2).alias("level"), F.col("c_custkey").alias("ord"), F.lit(1).alias("mode")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH n AS (SELECT n_nationkey + 100 AS id, n_regionkey + 1 AS root, 100 - n_nationkey AS ord, n_nationkey % 2 = 0 AS heading FROM nation),
     w AS (SELECT root, id, ord, NULL AS ord2, EXISTS (SELECT 1 FROM customer WHERE c_nationkey + 100 = n.id) AS has_children FROM n
           UNION ALL SELECT root, c_custkey + 1000, ord, c_custkey, false FROM customer JOIN n ON id = c_nationkey + 100 WHERE heading)
SELECT root, id, has_children, CAST(row_number() OVER (PARTITION BY root ORDER BY ord, ord2 NULLS FIRST) AS INTEGER) AS place FROM w
""")
def option_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options below each root, through headings alone, in reading order."""
    nodes = bank(spark, sf_dir)
    roots = nodes.filter("level = 0").select(F.col("id").alias("root"))
    return questions.walk(nodes, roots).select("root", "id", "has_children", "place")


@query("""
WITH n AS (SELECT n_nationkey + 100 AS id, n_regionkey AS r, 100 - n_nationkey AS ord, '1.' || n_regionkey || '.' || n_nationkey || ' ' || n_name AS title FROM nation)
SELECT id, 0 AS place, r_name AS above FROM n JOIN region ON r_regionkey = r
UNION ALL SELECT c_custkey + 1000, 0, title FROM customer JOIN n ON id = c_nationkey + 100
UNION ALL SELECT a.id, 1, arg_min(b.title, b.id) FROM n a JOIN n b ON starts_with(b.title, '1.' || a.r) AND b.ord < a.ord GROUP BY a.id
""")
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles above each question: its parent's, then those of shorter numbers."""
    return questions.titles_above(bank(spark, sf_dir))


@query("""
SELECT p_partkey, '焦虑' || p_size % 5 || '级(A' || p_size % 5 || ')     抑郁' || p_partkey % 6 || '级(B' || p_partkey % 6 || ')。' AS result, CAST(p_size % 5 AS INTEGER) AS first_level, CAST(p_partkey % 6 AS INTEGER) AS second_level FROM part
""")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as text, and the levels read back out of it."""
    made = table(spark, sf_dir, "part").select("p_partkey", questions.result_text((F.col("p_size") % 5).cast("int"), (F.col("p_partkey") % 6).cast("int")).alias("result"))
    found = questions.digits_of(F.col("result"))
    return made.select("p_partkey", "result", F.get(found, F.lit(0)).alias("first_level"), F.get(found, F.lit(2)).alias("second_level"))


@query("""
WITH s AS (SELECT c_custkey AS id, n_regionkey, n_nationkey, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT id, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY n_regionkey, n_nationkey, id) AS INTEGER) AS place FROM s
""")
def answer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by their paths, then by their ids."""
    joined = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    rows = joined.select(F.col("c_custkey").alias("id"), "c_mktsegment", F.array("n_regionkey", "n_nationkey").alias("path"))
    return questions.listing(rows, ["c_mktsegment"], "path", "id").select("id", "c_mktsegment", "place")


#: Herbs of the compositions below.
HERBS = ("人参", "白术", "甘草", "半夏", "桂枝", "陈皮", "茯苓", "大枣")

_FORMS = """
WITH p AS (SELECT p_partkey AS k, p_size AS q, ['人参', '白术', '甘草', '半夏', '桂枝', '陈皮', '茯苓', '大枣'][p_size % 8 + 1] AS a, p_partkey % 8 AS form FROM part),
i AS (
  SELECT k, 1 AS place, a AS herb, q || '钱' AS dose, '' AS note, NULL AS grams FROM p WHERE form = 0 UNION ALL SELECT k, 2, '甘草', '500mg', '', 0.5 FROM p WHERE form = 0
  UNION ALL SELECT k, 1, a, '三两', '', NULL FROM p WHERE form = 1 UNION ALL SELECT k, 2, '白术', '三两', '（炒）', NULL FROM p WHERE form = 1
  UNION ALL SELECT k, 1, a, '等分', '(去皮)', NULL FROM p WHERE form = 2 UNION ALL SELECT k, 2, '大枣', '等分', '', NULL FROM p WHERE form = 2
  UNION ALL SELECT k, 1, a, q || '钱半', '', (q + 0.5) * 3 FROM p WHERE form = 3 UNION ALL SELECT k, 2, '半夏', '半升', '', NULL FROM p WHERE form = 3
  UNION ALL SELECT k, 0, NULL, NULL, NULL, NULL FROM p WHERE form IN (4, 6)
  UNION ALL SELECT k, 1, a, '三钱二分', '', 9.6 FROM p WHERE form = 5 UNION ALL SELECT k, 2, '大枣', q || '枚', '', NULL FROM p WHERE form = 5
  UNION ALL SELECT k, 1, a, '', '', NULL FROM p WHERE form = 7 UNION ALL SELECT k, 2, '茯苓', q || 'g', '', q FROM p WHERE form = 7)
"""


def dosed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Compositions in eight forms (shared, equal, half, several quantities, unknown,
    unclear, undosed), and their items; factors are confirmed for forms 3 and 5."""
    q, form = F.col("p_size").cast("string"), F.pmod("p_partkey", F.lit(8))
    a = F.element_at(F.array(*map(F.lit, HERBS)), (F.pmod("p_size", F.lit(8)) + 1).cast("int"))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    text = (
        F.when(form == 0, said(a, q, "钱甘草500mg")).when(form == 1, said(a, "，白术（炒）各三两")).when(form == 2, said(a, "(去皮)大枣等分")).when(form == 3, said(a, q, "钱半半夏半升"))
        .when(form == 4, said("怪药", q, "克")).when(form == 5, said(a, "三钱二分、大枣", q, "枚")).when(form == 6, said(a, "一二两")).otherwise(said(a, "茯苓", q, "g"))
    )
    texts = table(spark, sf_dir, "part").select("p_partkey", form.alias("form"), text.alias("composition"))
    old = F.when(F.col("form") == 3, F.array(F.struct(F.lit("钱").alias("unit"), F.lit(3).cast("decimal(20,9)").alias("factor"))))
    both = F.when(F.col("form") == 5, F.array(*(F.struct(F.lit(u).alias("unit"), F.lit(n).cast("decimal(20,9)").alias("factor")) for u, n in (("钱", "3"), ("分", "0.3")))))
    short = F.when(F.col("form") == 0, F.array(F.struct(F.lit("两").alias("unit"), F.lit(31).cast("decimal(20,9)").alias("factor"))))
    factors = texts.select("p_partkey", F.explode(F.coalesce(old, both, short)).alias("f")).select("p_partkey", "f.*")
    return texts, doses.to_grams(doses.extract(texts, "p_partkey", "composition", HERBS), factors, "p_partkey")


@query(_FORMS + "SELECT k AS p_partkey, place, herb, dose, note, CAST(grams AS DOUBLE) AS grams, k % 8 = 0 AS refused FROM i")
def dose_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compositions read as doses and converted where factors were confirmed."""
    _, items = dosed(spark, sf_dir)
    return items.select("p_partkey", "place", "herb", "dose", "note", F.col("grams").cast("double").alias("grams"), "refused")


@query(_FORMS + """,
g AS (SELECT k, string_agg(herb || coalesce(regexp_replace(regexp_replace(CAST(CAST(grams AS DECIMAL(20, 6)) AS VARCHAR), '0+$', ''), '\\.$', '') || 'g', nullif(dose, ''), '（剂量待核）') || note, '、' ORDER BY place) AS text FROM i WHERE herb IS NOT NULL GROUP BY k)
SELECT p.k AS p_partkey, coalesce(text, CASE form WHEN 4 THEN '怪药' || q || '克' ELSE a || '一二两' END) AS text,
       CASE form WHEN 0 THEN 'old_weights' WHEN 1 THEN 'old_weights' WHEN 2 THEN '' WHEN 3 THEN 'old_weights,counts_kept' WHEN 5 THEN 'old_weights,counts_kept' WHEN 7 THEN 'dose_missing' ELSE 'not_separated' END AS warnings
FROM p LEFT JOIN g USING (k)
""")
def dose_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compositions as they are shown, with warnings."""
    texts, items = dosed(spark, sf_dir)
    return doses.references(texts, items, "p_partkey", "composition").select("p_partkey", "text", F.array_join("warnings", ",").alias("warnings"))
