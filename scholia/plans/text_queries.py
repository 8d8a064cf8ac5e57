"""Queries over text functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filters, passes, search
from .registry import query, table


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(trim(text)), '[a-z0-9]+') AS a FROM documents)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_tokens, CAST(len(list_distinct(a)) AS BIGINT) AS n_distinct FROM t
""")
def tok_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", X.search_tokens(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


@query(r"""
WITH p AS (
  SELECT conv_id, turn, x AS phrase, i
  FROM (SELECT conv_id, turn, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS i
        FROM (SELECT conv_id, turn, regexp_split_to_array(lower(trim(text)), '[\s,，、;；。.!！?？:：/|]+') AS a FROM conversations))
), d AS (SELECT conv_id, turn, phrase, min(i) AS i FROM p WHERE phrase <> '' GROUP BY ALL)
SELECT conv_id, turn, phrase, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS INTEGER) AS place FROM d
""")
def phrase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    placed = turns.select("conv_id", "turn", F.posexplode(X.split_phrases(F.col("text"))).alias("place", "phrase"))
    return placed.withColumn("place", F.col("place") + 1)


@query(r"""
WITH p AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(trim(text)), '[\s,，、;；。.!！?？:：/|]+')) AS phrase FROM benchmark),
     u AS (SELECT DISTINCT phrase FROM p WHERE phrase <> ''),
     g AS (SELECT phrase, list_distinct(flatten(list_transform(regexp_extract_all(phrase, '[a-z0-9]+|[㐀-鿿]+'), lambda r: CASE WHEN r < '㐀' OR length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))) AS grams FROM u),
     d AS (SELECT doc_id, lower(trim(text)) AS text FROM documents WHERE trim(text) <> ''),
     s AS (SELECT phrase, doc_id, CASE WHEN contains(text, phrase) THEN 1.0 ELSE coalesce(list_avg(list_transform(grams, lambda g: CAST(contains(text, g) AS INTEGER))), 0.0) END AS similarity FROM g CROSS JOIN d)
SELECT p.item_id, p.phrase, s.doc_id, s.similarity FROM p LEFT JOIN s ON s.phrase = p.phrase AND s.similarity >= 0.5 WHERE p.phrase <> ''
""")
def phrase_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each phrase of each query with every entry that resembles it, from the threshold of
    reranking (0.5) on; a phrase that no entry resembles has a row without one."""
    phrases = search.stored(table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.split_phrases(F.col("text"))).alias("phrase")).distinct())
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.normalize(F.col("text")).alias("text"))
    alike = passes.similar_pairs(entries, phrases, search.LIKE)
    return phrases.join(alike, "phrase").select("item_id", "phrase", F.col("id").alias("doc_id"), "similarity")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey < 100000 THEN lpad(CAST(o_orderkey AS VARCHAR), 5, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS id FROM orders),
     b AS (SELECT o_orderkey, id, translate(id, '01', 'Ol') AS damaged FROM o)
SELECT o_orderkey, damaged, translate(damaged, 'OoIl', '0011') AS repaired, translate(damaged, 'OoIl', '0011') = id AS restored,
       CAST(CASE length(id) WHEN 5 THEN 46 WHEN 6 THEN 1 + list_sum(list_transform(range(2, 7), lambda i: CASE WHEN substr(id, i, 1) <> substr(id, i - 1, 1) THEN 1 ELSE 0 END)) ELSE 0 END AS INTEGER) AS n_candidates
FROM b
""")
def id_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    ids = table(spark, sf_dir, "orders").select(key, F.when(key < 100000, F.lpad(key.cast("string"), 5, "0")).otherwise(key.cast("string")).alias("id"))
    damaged = ids.withColumn("damaged", F.translate("id", "01", "Ol")).withColumn("repaired", X.repair_id(F.col("damaged")))
    return damaged.select(
        "o_orderkey", "damaged", "repaired", F.size(X.digit_repairs(F.col("repaired"))).alias("n_candidates"), (F.col("repaired") == F.col("id")).alias("restored")
    )


@query(r"""
SELECT p_partkey, regexp_replace(p_name || ' ... *', '[\s.·…*＊]+', '', 'g') AS compact,
       regexp_replace('; ' || p_name || ',. ', '^[\s,.;:，。；：、]+|[\s,.;:，。；：、]+$', '', 'g') AS cleaned FROM part
""")
def name_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.compact_name(F.concat(name, F.lit(" ... *"))).alias("compact"), X.clean_term(F.concat(F.lit("; "), name, F.lit(",. "))).alias("cleaned")
    )


@query("""
WITH c AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 240.0) AS BIGINT))) AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(length(substr(text, i * 240 + 1, 240)) AS INTEGER) AS n_chars, md5(substr(text, i * 240 + 1, 240)) AS digest FROM c
""")
def chunk240(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk", "piece"))
    return cut.select("doc_id", "chunk", F.length("piece").alias("n_chars"), F.md5(F.col("piece").cast("binary")).alias("digest"))


@query("""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
     p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l WHERE x <> ''),
     t AS (SELECT doc_id, string_agg(CASE WHEN regexp_full_match(right(before, 1), '[A-Za-z0-9]') AND regexp_full_match(left(x, 1), '[A-Za-z0-9]') THEN ' ' ELSE '' END || x, '' ORDER BY i) AS text FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(length(coalesce(t.text, '')) AS INTEGER) AS n_chars, md5(coalesce(t.text, '')) AS digest FROM documents d LEFT JOIN t USING (doc_id)
""")
def wrap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", X.join_wrapped(F.split("text", "\n")).alias("joined"))
    return joined.select("doc_id", F.length("joined").alias("n_chars"), F.md5(F.col("joined").cast("binary")).alias("digest"))


@query("""
SELECT doc_id, source FROM documents
WHERE (contains(lower(text), 'the') OR contains(lower(source), 'the')) AND (contains(lower(text), 'src1') OR contains(lower(source), 'src1'))
""")
def multi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(filters.matches_all("The SRC1", [F.col("text"), F.col("source")])).select("doc_id", "source")


@query("""
SELECT doc_id, source FROM documents
WHERE NOT ((contains(lower(text), 'the') OR contains(lower(source), 'the')) AND (contains(lower(text), 'src1') OR contains(lower(source), 'src1')))
""")
def multi_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(filters.matches_none("The SRC1", [F.col("text"), F.col("source")])).select("doc_id", "source")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderdate > TIMESTAMP '1996-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-03-01 23:59:59' AND o_orderstatus = 'F'
""")
def date_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = table(spark, sf_dir, "orders").filter(filters.within_days(F.col("o_orderdate"), "1996-03-01", "1997-03-01") & (F.col("o_orderstatus") == "F"))
    return visits.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""
SELECT event_id, user_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS VARCHAR) = '42'
""")
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the owner named in a row's JSON may see."""
    return table(spark, sf_dir, "events").filter(filters.owned_by(F.col("props"), "k", 42)).select("event_id", "user_id", "event_type")


@query("""
WITH d AS (
  SELECT 'header' AS rule, CASE WHEN len(string_split(text, chr(10))) > 40 THEN 'too_many_lines'
    WHEN length(split_part(text, chr(10), 1)) > 18 AND NOT contains(split_part(text, chr(10), 1), ' ') THEN 'running_header' ELSE 'ok' END AS reason FROM documents
  UNION ALL
  SELECT 'query', CASE WHEN len(p) > 20 THEN 'too_many_phrases' WHEN len(list_filter(p, lambda x: length(x) > 240)) > 0 THEN 'phrase_too_long' WHEN length(text) > 1000 THEN 'text_too_long'
    WHEN turn NOT BETWEEN 1 AND 20 THEN 'bad_top_k' WHEN len(p) = 0 AND trim(text) = '' THEN 'empty' ELSE 'ok' END
  FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '[\\s,，、;；。.!！?？:：/|]+'), lambda x: x <> '')) AS p FROM conversations)
  UNION ALL
  SELECT 'segment', CASE WHEN turn <= 0 THEN 'bad_index' WHEN turn * 10000 >= turn * 10000 + length(text) * 10 OR turn * 10000 + length(text) * 10 > 7200000 THEN 'bad_times' WHEN length(text) < 1 OR length(text) > 4000 THEN 'bad_text'
    WHEN sum(length(text)) OVER (PARTITION BY conv_id) > 50000 THEN 'total_too_long' ELSE 'ok' END FROM conversations
  UNION ALL
  SELECT 'answer', 'ok' FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N' AND p_size % 5 > 0 AND p_size % 7 > 0
  UNION ALL
  SELECT 'configured', CASE WHEN o_orderkey BETWEEN 100 AND 9000 THEN 'ok' ELSE 'outside' END FROM orders
  UNION ALL
  SELECT 'history', CASE WHEN event_type <> 'purchase' THEN 'not_shown' ELSE 'ok' END FROM events
)
SELECT rule, reason, count(*) AS n FROM d GROUP BY ALL
""")
def predicate_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and rejected rows by the first broken rule, for six validations."""
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    key, text = F.col("o_orderkey"), F.col("text")
    asked = turns.select(X.split_phrases(text).alias("symptoms"), text.alias("free_text"), F.col("turn").alias("top_k"))
    start = F.col("turn") * 10_000
    segments = turns.select("conv_id", F.col("turn").alias("index"), start.alias("start_ms"), (start + F.length(text) * 10).alias("end_ms"), "text")
    bank = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("q_id"), F.when(F.col("p_size") % 5 == 0, filters.UNCHANGED[0]).otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_size") % 7 == 0, -1).otherwise(1).alias("mode")
    )
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("q_id"), F.when(F.col("l_returnflag") == "N", "0").otherwise("1").alias("value"))
    volumes = spark.createDataFrame([("1", 100, 9000)], "volume string, first_entry_id long, last_entry_id long")
    configured = filters.in_configured_range(table(spark, sf_dir, "orders").select(F.lit("1").alias("volume"), key.alias("id")), volumes)
    packs = {
        "header": (docs, [("too_many_lines", F.size(F.split("text", "\n")) <= 40), ("running_header", (F.length(first) <= 18) | F.contains(first, F.lit(" ")))]),
        "query": (asked, filters.query_rules(["symptoms"])),
        "segment": (segments, filters.segment_rules(["conv_id"])),
        "answer": (filters.given_answers(answers, bank), []),
        "configured": (configured, [("outside", F.col("in_range"))]),
        "history": (table(spark, sf_dir, "events"), [("not_shown", F.col("event_type") == "purchase")]),
    }
    out = None
    for name, (df, rules) in packs.items():
        part = filters.with_reason(df, rules).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "reason", "n")
        out = part if out is None else out.unionByName(part)
    return out
