"""Queries over joins, trees and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fuzzy, joins
from .registry import query, table


@query("""
SELECT d.doc_id, d.lang, CASE WHEN l.quality = 0 AND d.lang = 'en' THEN 'drop_line' WHEN l.toxic = 1 THEN 'hold' END AS action
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def two_tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on (entry, language) goes before one on the entry alone."""
    labels = table(spark, sf_dir, "labels")
    exact = labels.filter("quality = 0").select("doc_id", F.lit("en").alias("lang"), F.lit("drop_line").alias("action"))
    loose = labels.filter("toxic = 1").select("doc_id", F.lit("hold").alias("action"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return joins.two_tier(docs, exact, loose, ["doc_id", "lang"], ["doc_id"], "action").select("doc_id", "lang", "action")


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 AND p_brand <> 'Brand#1' THEN upper(p_name) ELSE p_name END AS p_name,
       CASE WHEN p_brand <> 'Brand#1' THEN p_size > 25 END AS applied FROM part
""")
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name is corrected only where it still reads as the correction says."""
    part = table(spark, sf_dir, "part")
    old = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" x")))
    fixes = part.filter("p_brand <> 'Brand#1'").select("p_partkey", old.alias("old"), F.upper("p_name").alias("new"))
    return joins.guarded_rename(part.select("p_partkey", "p_name"), fixes, "p_partkey", "p_name")


@query("""
WITH r AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_orderkey // 100),
     e AS (SELECT unnest(range(lo, hi + 1)) AS id FROM r),
     m AS (SELECT id FROM e EXCEPT SELECT l_orderkey FROM lineitem)
SELECT m.id, coalesce(CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderpriority END, CASE WHEN c.c_mktsegment <> 'BUILDING' THEN c.c_mktsegment END, 'unnamed') AS name
FROM m LEFT JOIN orders o ON o.o_orderkey = m.id LEFT JOIN customer c ON c.c_custkey = o.o_custkey
""")
def range_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that no line mentions, from ranges of ids, named by precedence."""
    orders = table(spark, sf_dir, "orders")
    ranges = orders.groupBy(F.floor(F.col("o_orderkey") / 100).alias("block")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    expected = joins.expand_ranges(ranges, "lo", "hi", "id").select("id")
    missing = expected.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "id", "left_anti")
    named = missing.join(orders, F.col("id") == F.col("o_orderkey"), "left").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    name = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), F.lit("unnamed"))
    return named.select("id", name.alias("name"))


@query("""
WITH n AS (SELECT DISTINCT p_brand, p_name FROM part),
     p AS (SELECT a.p_brand, a.p_name, b.p_name AS other, levenshtein(a.p_name, b.p_name) AS distance FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name)
SELECT p_brand, p_name, other, CAST(distance AS INTEGER) AS distance FROM p WHERE distance <= 5
QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY distance, other) = 1
""")
def fuzzy_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other name of the same brand, up to five edits away."""
    names = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    pairs = fuzzy.within(names, names.withColumnRenamed("p_name", "other"), ["p_brand"], "p_name", "other", 5).filter("p_name <> other")
    return joins.best_per(pairs, ["p_brand", "p_name"], [F.col("distance"), F.col("other")])


@query("""
WITH s AS (SELECT p_partkey, p_name AS body, CASE WHEN p_size % 7 = 0 THEN upper(p_name) ELSE p_name END AS toc,
             CASE WHEN p_retailprice > 1500 THEN p_brand ELSE p_name END AS second, CASE WHEN p_size = 50 THEN p_name END AS verified FROM part),
     j AS (SELECT *, CASE WHEN verified IS NOT NULL THEN 'verified' WHEN body = toc AND body = second THEN 'agreed' WHEN body = toc THEN 'toc_confirms'
             WHEN body = second THEN 'second_confirms' WHEN toc = second THEN 'body_differs' ELSE 'unresolved' END AS status FROM s)
SELECT status, count(*) AS n FROM j GROUP BY status
""")
def name_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body name against listing, second reading and a verified list."""
    part = table(spark, sf_dir, "part")
    body = part.select("p_partkey", F.col("p_name").alias("body"))
    toc = part.select("p_partkey", F.when(F.col("p_size") % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("toc"))
    second = part.select("p_partkey", F.when(F.col("p_retailprice") > 1500, F.col("p_brand")).otherwise(F.col("p_name")).alias("second"))
    verified = part.filter("p_size = 50").select("p_partkey", F.col("p_name").alias("verified"))
    joined = body.join(toc, "p_partkey", "left").join(second, "p_partkey", "left").join(verified, "p_partkey", "left")
    status = (
        F.when(F.col("verified").isNotNull(), "verified")
        .when((F.col("body") == F.col("toc")) & (F.col("body") == F.col("second")), "agreed")
        .when(F.col("body") == F.col("toc"), "toc_confirms")
        .when(F.col("body") == F.col("second"), "second_confirms")
        .when(F.col("toc") == F.col("second"), "body_differs")
        .otherwise("unresolved")
    )
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""
SELECT p_name, count(*) AS n_same, arg_max(p_partkey, struct_pack(a := p_size, b := p_retailprice, c := -p_partkey)) AS best FROM part GROUP BY p_name
""")
def same_name_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same name, and the best of them by size, price and lowest key."""
    order = F.struct("p_size", "p_retailprice", (-F.col("p_partkey")).alias("k"))
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n_same"), F.max_by("p_partkey", order).alias("best"))


@query("""
WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, p_size > 10 AS valid FROM lineitem JOIN part ON p_partkey = l_partkey),
     f AS (SELECT l_orderkey, l_partkey, bool_and(valid) AS valid FROM j GROUP BY ALL)
SELECT l_orderkey, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid, max(l_partkey) FILTER (valid) AS last_valid FROM f GROUP BY l_orderkey
""")
def symptom_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms (orders) and the entries (parts) they cite, once each; entries that are not
    indexed do not count as links."""
    entries = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("indexed"))
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().join(entries, "l_partkey", "left")
    valid = F.col("indexed").isNotNull()
    return cited.groupBy("l_orderkey").agg(F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_invalid"), F.max(F.when(valid, F.col("l_partkey"))).alias("last_valid"))


@query("""
WITH c AS (SELECT event_id AS chunk, user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e FROM events WHERE event_type = 'view'),
     x AS (SELECT event_id AS excerpt, user_id, epoch_us(ts) - 1800000000 AS s, epoch_us(ts) + 1800000000 AS e FROM events WHERE event_type = 'click')
SELECT chunk, excerpt FROM c JOIN x ON c.user_id = x.user_id AND c.s < x.e AND x.s < c.e
""")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour-long chunks that overlap an excerpt of the same recording (user)."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events")
    chunks = events.filter("event_type = 'view'").select(F.col("event_id").alias("chunk"), "user_id", at.alias("l_start"), (at + 3_600_000_000).alias("l_stop"))
    excerpts = events.filter("event_type = 'click'").select(F.col("event_id").alias("excerpt"), "user_id", (at - 1_800_000_000).alias("r_start"), (at + 1_800_000_000).alias("r_stop"))
    return joins.overlaps(chunks, excerpts, ["user_id"], 3_600_000_000).select("chunk", "excerpt")


@query("""
WITH cited AS (SELECT conv_id, turn AS citing, unnest([turn - 1, turn + 1]) AS cited FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, c.citing, c.cited FROM cited c WHERE NOT EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = c.conv_id AND t.turn = c.cited)
""")
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that a summary cites and that do not exist."""
    turns = table(spark, sf_dir, "conversations")
    cited = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("citing"), F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("cited"))
    return cited.join(turns.select("conv_id", F.col("turn").alias("cited")), ["conv_id", "cited"], "left_anti").select("conv_id", "citing", "cited")


@query("""
WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
             UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
  t AS (SELECT id, name AS path, 0 AS level FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.path || '/' || n.name, t.level + 1 FROM n JOIN t ON n.parent = t.id)
SELECT id, path, CAST(level AS INTEGER) AS level FROM t
""")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    def nodes(name: str, mark: str, key: str, label: str, parent: str | None, above: str = "") -> DataFrame:
        up = F.concat(F.lit(above), F.col(parent)) if parent else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(F.concat(F.lit(mark), F.col(key)).alias("id"), up.alias("parent"), F.col(label).alias("name"))

    tree = nodes("region", "r", "r_regionkey", "r_name", None).union(nodes("nation", "n", "n_nationkey", "n_name", "n_regionkey", "r"))
    tree = tree.union(nodes("customer", "c", "c_custkey", "c_name", "c_nationkey", "n")).union(nodes("supplier", "s", "s_suppkey", "s_name", "s_nationkey", "n"))
    return joins.ancestors(tree).select("id", F.array_join("path", "/").alias("path"), "level")


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN p_partkey + 1 WHEN p_partkey % 50 = 1 AND p_partkey > 50 THEN p_partkey - 1 WHEN p_partkey % 10 = 7 THEN -p_partkey WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part),
  t AS (SELECT id, CAST(id AS VARCHAR) AS path, 0 AS level, CASE WHEN parent IS NULL THEN 'whole' ELSE 'orphan' END AS state FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
        UNION ALL SELECT n.id, t.path || '/' || n.id, t.level + 1, state FROM n JOIN t ON n.parent = t.id)
SELECT n.id, coalesce(t.path, '') AS path, CAST(coalesce(t.level, -1) AS INTEGER) AS level, coalesce(t.state, 'cycle') AS state FROM n LEFT JOIN t ON t.id = n.id
""")
def deep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in a tree whose depth grows with the table, with lost parents and rings in it."""
    key = F.col("p_partkey").cast("long")
    parent = F.when(key % 50 == 0, key + 1).when((key % 50 == 1) & (key > 50), key - 1).when(key % 10 == 7, -key).when(key > 1, F.floor(key / 2))
    nodes = table(spark, sf_dir, "part").select(key.alias("id"), parent.alias("parent"), key.cast("string").alias("name"))
    path, level = F.coalesce(F.array_join("path", "/"), F.lit("")), F.coalesce("level", F.lit(-1))
    return joins.ancestors(nodes).select("id", path.alias("path"), level.alias("level"), "state")


@query("""
WITH child AS (SELECT n_nationkey, n_name, r_name, count(c_custkey) AS n_customers FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT r_name, CAST(count(*) AS BIGINT) AS n_nations, CAST(sum(n_customers) AS BIGINT) AS n_customers, string_agg(n_name || ':' || n_customers, ',' ORDER BY n_name) AS children FROM child GROUP BY r_name
""")
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children gathered under their parent, level by level from below."""
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    nations = table(spark, sf_dir, "nation").join(customers, "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    joined = nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    child = F.array_sort(F.collect_list(F.struct("n_name", "n")))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["n_name"], x["n"])), ",")
    return joined.groupBy("r_name").agg(F.count("*").alias("n_nations"), F.sum("n").alias("n_customers"), child.alias("c")).select("r_name", "n_nations", "n_customers", text.alias("children"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, p_brand, p_size FROM lineitem JOIN part ON p_partkey = l_partkey),
     none AS (SELECT DISTINCT l_orderkey, p_brand FROM a WHERE p_size = 1)
SELECT a.l_orderkey, count(*) AS n, count(*) FILTER (n.p_brand IS NOT NULL AND a.p_size <> 1) AS blanked FROM a LEFT JOIN none n ON n.l_orderkey = a.l_orderkey AND n.p_brand = a.p_brand GROUP BY a.l_orderkey
""")
def exclusion_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choosing the "none" option (size 1) of a group blanks the group's other answers."""
    answers = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    none = answers.filter("p_size = 1").select("l_orderkey", "p_brand", F.lit(True).alias("cleared")).distinct()
    flagged = answers.join(none, ["l_orderkey", "p_brand"], "left")
    return flagged.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("cleared").isNotNull() & (F.col("p_size") != 1)).alias("blanked"))


@query("""
SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'indexed' WHEN 0 THEN 'review' END, 'missing') AS status, l.doc_id IS NOT NULL AS listed, d.source || '-' || d.lang AS volume,
       EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id) AS has_query FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def lookup_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index status by a left join, volume tag, and whether a child row exists."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("listed"))
    child = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("child")).distinct()
    joined = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").join(child, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "indexed").when(F.col("quality") == 0, "review").otherwise("missing")
    return joined.select("doc_id", status.alias("status"), F.col("listed").isNotNull().alias("listed"), F.concat_ws("-", "source", "lang").alias("volume"), F.col("child").isNotNull().alias("has_query"))


@query("""
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS place,
             lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS previous, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next FROM part)
SELECT p_partkey, CAST(place AS INTEGER) AS place, 100 - 2 * (CAST(place AS INTEGER) - 1) AS base_score, previous, next FROM r
""")
def order_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order among siblings by several keys, base score from the rank, neighbours by id."""
    by_quality = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey")
    by_id = Window.partitionBy("p_brand").orderBy("p_partkey")
    place = F.row_number().over(by_quality)
    return table(spark, sf_dir, "part").select(
        "p_partkey", place.alias("place"), (100 - 2 * (place - 1)).alias("base_score"), F.lag("p_partkey").over(by_id).alias("previous"), F.lead("p_partkey").over(by_id).alias("next")
    )


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'common' AS kind, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first_only', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)
""")
def set_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in, beside and over two id sets."""
    orders = table(spark, sf_dir, "orders")
    a, b = (orders.filter(c).select("o_custkey").distinct() for c in ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'"))
    parts = {"common": a.intersect(b), "first_only": a.join(b, "o_custkey", "left_anti"), "either": a.union(b).distinct()}
    out = None
    for kind, df in parts.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out
