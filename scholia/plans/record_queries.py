"""Queries over questionnaires, visits, prompts and retention."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import filters, records, survey
from .registry import query, table


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a person (customer) to questions (parts), with both dimensions."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("person"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select("l_orderkey", "l_partkey")
    bank = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_type").isin("ECONOMY", "STANDARD", "SMALL"), "first").otherwise("second").alias("dimension"),
        F.pmod("p_size", F.lit(11)).alias("level"),
        F.when(F.pmod(F.substring_index("p_brand", "#", -1).cast("int"), F.lit(2)) == 0, "defining").otherwise("one_of").alias("kind"),
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(bank, F.col("l_partkey") == F.col("p_partkey"))


_ANSWERS = """
WITH a AS (SELECT o_custkey AS person, CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'SMALL') THEN 'first' ELSE 'second' END AS dimension, p_size % 11 AS level,
             CASE WHEN CAST(split_part(p_brand, '#', 2) AS INTEGER) % 2 = 0 THEN 'defining' ELSE 'one_of' END AS kind
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 10),
"""


@query(_ANSWERS + """
k AS (SELECT person, dimension, level, kind, count(*) AS n FROM a GROUP BY ALL),
l AS (SELECT person, dimension, level, max(CASE WHEN level = 0 THEN 0 WHEN kind = 'one_of' THEN 3 * level - 2 ELSE 3 * level END + n - 1) AS points,
        coalesce(sum(n) FILTER (kind = 'defining'), 0) AS nd FROM k GROUP BY ALL),
d AS (SELECT person, dimension, coalesce(sum(points) FILTER (level > 0)::DOUBLE / sum(3 * level) FILTER (level > 0) * max(points) FILTER (level > 0), 0) AS score,
        0.3 * coalesce(sum(nd) FILTER (level = 0), 0)::DOUBLE AS zero FROM l GROUP BY ALL),
w AS (SELECT person, coalesce(sum(score) FILTER (dimension = 'first'), 0) AS s1, coalesce(sum(score) FILTER (dimension = 'second'), 0) AS s2,
        coalesce(sum(zero) FILTER (dimension = 'first'), 0) AS z1, coalesce(sum(zero) FILTER (dimension = 'second'), 0) AS z2 FROM d GROUP BY person),
r AS (SELECT person, round(s1 + CASE WHEN z1 = z2 THEN z1 WHEN z1 > z2 THEN z1 + z2 ELSE 0 END, 6) AS first, round(s2 + CASE WHEN z1 = z2 THEN z2 WHEN z1 > z2 THEN 0 ELSE z1 + z2 END, 6) AS second FROM w)
SELECT *, CAST(CASE WHEN first <= 0 THEN 0 WHEN first <= 3 THEN 1 WHEN first <= 6 THEN 2 WHEN first <= 9 THEN 3 WHEN first <= 12 THEN 4 ELSE 5 END AS INTEGER) AS first_level,
       CAST(CASE WHEN second <= 0 THEN 0 WHEN second <= 3 THEN 1 WHEN second <= 6 THEN 2 WHEN second <= 9 THEN 3 WHEN second <= 12 THEN 4 ELSE 5 END AS INTEGER) AS second_level FROM r
""")
def survey_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.scores(answers(spark, sf_dir))


@query(_ANSWERS.rstrip().rstrip(",") + """
SELECT coalesce(dimension, 'all') AS dimension, coalesce(kind, 'all') AS kind, CAST(coalesce(level, -1) AS INTEGER) AS level, count(*) AS n FROM a GROUP BY ROLLUP (dimension, kind, level)
""")
def level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = answers(spark, sf_dir).rollup("dimension", "kind", "level").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("dimension", F.lit("all")).alias("dimension"), F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("level", F.lit(-1)).alias("level"), "n")


@query("""
WITH s AS (SELECT o_custkey AS person, o_orderkey AS screen, p_brand AS node, p_name AS title, p_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 1),
     f AS (SELECT *, row_number() OVER (PARTITION BY person, node ORDER BY screen, p_partkey) AS k FROM s)
SELECT person, screen, node, min(title) AS title FROM f WHERE k = 1 GROUP BY ALL
""")
def answer_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings (brands) of the answers of a person, each where it is first met."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("person"))
    bank = table(spark, sf_dir, "part").filter("p_size > 1").select("p_partkey", F.col("p_brand").alias("node"), F.col("p_name").alias("title"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("screen"), "l_partkey")
    steps = lines.join(orders, F.col("screen") == F.col("o_orderkey")).join(bank, F.col("l_partkey") == F.col("p_partkey"))
    return survey.first_seen(steps, "person", "node", [F.col("screen"), F.col("p_partkey")]).select("person", "screen", "node", "title")


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey DESC) = 1
""")
def latest_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest visit of a person, of the wanted kind if there is one."""
    order = [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_orderkey")]
    return records.latest(table(spark, sf_dir, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""
SELECT c_custkey, coalesce(nullif(r.p, ''), c_mktsegment) AS shown FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) r ON r.o_custkey = c_custkey
""")
def latest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the newest revision, else the original."""
    newest = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("text"))
    return table(spark, sf_dir, "customer").join(newest, "c_custkey", "left").select("c_custkey", F.coalesce(F.nullif("text", F.lit("")), F.col("c_mktsegment")).alias("shown"))


@query("""
WITH g AS (SELECT d.doc_id, source, row_number() OVER (PARTITION BY source ORDER BY d.doc_id DESC) AS place FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic = 0)
SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY place) AS examples, count(*) AS n FROM g WHERE place <= 5 GROUP BY source
""")
def fewshot_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest good examples of each source, newest first."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    newest = records.latest(table(spark, sf_dir, "documents").join(good, "doc_id").select("doc_id", "source"), ["source"], [F.desc("doc_id")], 5)
    ids = newest.withColumn("text", F.col("doc_id").cast("string"))
    return records.concat_ordered(ids, ["source"], "place", "text", ",").select("source", F.col("text").alias("examples"), F.col("n_pieces").alias("n"))


@query("""
SELECT conv_id, CASE WHEN count(*) FILTER (role = 'system') > 0 THEN 'system: ' || CAST(count(*) FILTER (role = 'system') AS VARCHAR) || ', ' ELSE '' END || 'turns: ' || CAST(count(*) AS VARCHAR) AS header,
       md5(string_agg(role || '：' || text, chr(10) ORDER BY turn)) AS dialogue FROM conversations GROUP BY conv_id
""")
def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of facts without the blank ones, and the dialogue in order."""
    turns = table(spark, sf_dir, "conversations").withColumn("said", F.concat_ws("：", "role", "text")).withColumn("system", (F.col("role") == "system").cast("int"))
    systems = turns.groupBy("conv_id").agg(F.nullif(F.sum("system"), F.lit(0)).alias("systems"))
    dialogue = records.concat_ordered(turns, ["conv_id"], "turn", "said", "\n").join(systems, "conv_id")
    header = records.user_line([("system", F.col("systems")), ("turns", F.col("n_pieces"))])
    return dialogue.select("conv_id", header.alias("header"), F.md5(F.col("said").cast("binary")).alias("dialogue"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 250000 ORDER BY o_orderkey)
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM o) AS total, CASE WHEN (SELECT count(*) FROM o) > 60 THEN 60 END AS next_offset, 20 AS previous_offset FROM o WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 20
""")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 20 after a key (the paging operator), the third of its kind, with the total
    and the offsets of the pages beside it."""
    visits = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select("o_orderkey", "o_custkey")
    after, before = records.offsets(F.col("total"), 40, 20)
    paged = records.page(visits, "o_orderkey", 5000, 20).join(F.broadcast(visits.agg(F.count("*").alias("total"))))
    return paged.withColumn("next_offset", after).withColumn("previous_offset", before)


@query("""
SELECT o_custkey, o_orderkey, NULL AS o_orderpriority, TIMESTAMP '2024-01-01 00:00:00' AS o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
""")
def carried_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new visit for everybody: the latest one with today's date, its result blanked."""
    visits = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return records.carried_forward(visits, "o_custkey", [F.desc("o_orderkey")], ["o_orderpriority"], "o_orderdate", F.lit("2024-01-01 00:00:00"))


@query("""
SELECT c_custkey, c_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE (contains(c_name, '12') OR contains(n_name, '12')) AND (contains(lower(c_name), '1') OR contains(lower(n_name), '1')) AND c_mktsegment = 'BUILDING' AND c_acctbal >= 0
""")
def visit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits by words over name and nation, and equality on the other columns."""
    joined = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    found = joined.filter(filters.matches_all("12 1", [F.col("c_name"), F.col("n_name")]) & (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") >= 0))
    return found.select("c_custkey", "c_name", "c_mktsegment")


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (ts + INTERVAL 30 DAY <= TIMESTAMP '2024-02-05 12:00:00') AS deleted, count(*) FILTER (ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-05 12:00:00') AS held FROM events GROUP BY event_type
""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 30 days of retention have deleted by a given moment."""
    gone = records.expired(F.col("ts"), datetime.datetime(2024, 2, 5, 12, 0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("held"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)),
     l AS (SELECT o_custkey, o_orderstatus, max(o_orderkey) AS newest FROM orders GROUP BY ALL)
SELECT l.o_custkey, l.o_orderstatus, l.newest, (SELECT count(*) FROM p WHERE p.o_custkey = l.o_custkey) AS pending FROM l
""")
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row per key over stored and incoming rows, and what is still pending."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    stored, changes = orders.filter("o_orderkey < 1000"), orders.filter("o_orderkey >= 1000")
    merged = records.upsert(stored, changes, ["o_custkey", "o_orderstatus"], "o_orderkey")
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    pending = orders.join(done, "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("pending"))
    return merged.join(pending, "o_custkey", "left").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("newest"), F.coalesce("pending", F.lit(0)).alias("pending"))


@query("""
SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, md5(string_agg(text, '' ORDER BY turn)) AS output, max(turn) AS last, arg_max(role, turn) AS usage, count(*) AS n_pieces FROM conversations GROUP BY conv_id
""")
def delta_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed pieces as one output, with what the last piece says."""
    turns = table(spark, sf_dir, "conversations")
    final = turns.groupBy("conv_id").agg(F.max_by("role", "turn").alias("usage"))
    whole = records.concat_ordered(turns, ["conv_id"], "turn", "text").join(final, "conv_id")
    return whole.select("conv_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("output"), "last", "usage", "n_pieces")


@query("""
SELECT conv_id, count(*) AS n_segments, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(turn) * 10000 + least(10000, arg_max(length(text), turn) * 10) AS duration_ms FROM conversations GROUP BY conv_id
""")
def summary_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a recording: total text, and duration as the last start plus length."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_segments"), F.sum(F.length("text")).alias("n_chars"),
        (F.max("turn") * 10000 + F.least(F.lit(10000), F.max_by(F.length("text"), "turn") * 10)).alias("duration_ms"),
    )


@query("""
SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS version, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a record with the one before and after."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.row_number().over(order).alias("version"), F.lag("o_orderkey").over(order).alias("before"), F.lead("o_orderkey").over(order).alias("after")
    )
