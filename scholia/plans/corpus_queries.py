"""Queries over corpus assembly and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assembly, digests, quality
from .registry import query, table


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their labels, where there are any."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left")


@query("""
WITH s AS (SELECT d.source, CASE WHEN l.toxic = 1 THEN 'withheld' WHEN l.quality = 0 THEN 'partial' ELSE 'complete' END AS status
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) AS total, count(*) FILTER (status = 'complete') AS indexed, count(*) FILTER (status = 'withheld') AS withheld,
       count(*) FILTER (status = 'partial') AS partial FROM s GROUP BY source
""")
def index_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "withheld").when(F.col("quality") == 0, "partial")
    gated = quality.gate(labelled(spark, sf_dir), status)
    return gated.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if("indexed").alias("indexed"),
        F.count_if(F.col("record_status") == "withheld").alias("withheld"),
        F.count_if(F.col("record_status") == "partial").alias("partial"),
    )


@query("""
WITH d AS (SELECT d.doc_id, text, n_chars, string_split(text, chr(10)) AS lines, coalesce(l.quality, 1) AS quality, coalesce(l.toxic, 0) AS toxic
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, length(trim(text)) > 0 AND n_chars >= 200 AND quality = 1 AND toxic = 0 AND NOT contains(text, '|') AS admitted,
       CAST((len(lines) > 1)::INT + (n_chars > 1000)::INT + (contains(text, ','))::INT + (contains(text, '.'))::INT AS INTEGER) AS richness,
       CAST(least(40, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')))) AS INTEGER) AS works FROM d
""")
def core_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission to the core set, richness, and distinct capitalised words (cap 40)."""
    text = F.col("text")
    flag = lambda c: c.cast("int")
    admitted = (F.length(F.trim(text)) > 0) & (F.col("n_chars") >= 200) & (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & ~F.contains(text, F.lit("|"))
    richness = flag(F.size(F.split(text, "\n")) > 1) + flag(F.col("n_chars") > 1000) + flag(F.contains(text, F.lit(","))) + flag(F.contains(text, F.lit(".")))
    works = F.least(F.lit(40), F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][a-z]+"), F.lit(0)))))
    return labelled(spark, sf_dir).select("doc_id", admitted.alias("admitted"), richness.alias("richness"), works.alias("works"))


@query("""
WITH o AS (SELECT conv_id, turn, trim(text) AS text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS entry FROM conversations),
     p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id, entry ORDER BY turn) AS before FROM o WHERE entry > 0 AND text <> ''),
     t AS (SELECT conv_id, entry, string_agg(CASE WHEN regexp_full_match(right(before, 1), '[A-Za-z0-9]') AND regexp_full_match(left(text, 1), '[A-Za-z0-9]') THEN ' ' ELSE '' END || text, '' ORDER BY turn) AS text FROM p GROUP BY ALL)
SELECT conv_id, CAST(entry AS BIGINT) AS entry, (SELECT CAST(count(*) AS INTEGER) FROM o WHERE o.conv_id = t.conv_id AND o.entry = t.entry) AS n_lines, md5(text) AS text FROM t
""")
def entry_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns open entries, and the turns of each are joined like wrapped lines."""
    entries = assembly.assemble(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    return entries.select("conv_id", "entry", "n_lines", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""
WITH m AS (SELECT *, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS major,
             count(CASE WHEN role = 'system' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations)
SELECT conv_id, turn, major, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id, block ORDER BY turn) AS minor FROM m
""")
def category_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Major (system) and minor (user) headings carried forward; a major resets the minor."""
    turns = table(spark, sf_dir, "conversations")
    seen = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    system = F.when(F.col("role") == "system", F.col("turn"))
    major = assembly.carry_forward(turns, ["conv_id"], ["turn"], system, "major").withColumn("block", F.count(system).over(seen))
    minor = assembly.carry_forward(major, ["conv_id", "block"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "minor")
    return minor.select("conv_id", "turn", "major", "minor")


@query("""
WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, round(min(value), 6) AS least FROM i GROUP BY ALL
""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    islands = assembly.gap_islands(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 6 * 3600)
    return islands.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("least"))


@query("""
WITH g AS (SELECT event_type, count(*) AS n_lines, avg(value / 500) AS m, min(value / 500) AS least, count(*) FILTER (value / 500 < 0.7) AS n_low, count(*) FILTER (value / 500 < 0.8) AS n_medium
           FROM events GROUP BY event_type)
SELECT event_type, n_lines, round(m, 6) AS mean_confidence, round(least, 6) AS least_confidence, n_low, n_medium FROM g
UNION ALL SELECT 'all', sum(n_lines)::BIGINT, round(sum(n_lines * round(m, 6)) / sum(n_lines), 6), round(min(least), 6), sum(n_low)::BIGINT, sum(n_medium)::BIGINT FROM g
""")
def conf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence statistics per group, and over all by the line-weighted mean."""
    by_type = quality.confidence_stats(table(spark, sf_dir, "events"), ["event_type"], F.col("value") / 500)
    whole = by_type.agg(
        F.sum("n_lines").alias("n_lines"), F.round(quality.weighted_mean(by_type, "n_lines", "mean_confidence"), 6).alias("mean_confidence"),
        F.min("least_confidence").alias("least_confidence"), F.sum("n_low").alias("n_low"), F.sum("n_medium").alias("n_medium"),
    )
    return by_type.unionByName(whole.withColumn("event_type", F.lit("all")))


@query("""
WITH f AS (SELECT unnest([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '!!') THEN 'shouting' END,
                          CASE WHEN len(string_split(text, chr(10))) = 1 THEN 'one_line' END]) AS flag FROM documents)
SELECT flag, count(*) AS n FROM f WHERE flag IS NOT NULL GROUP BY flag
""")
def flag_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    flags = F.array(
        F.when(F.col("n_chars") < 300, "short"), F.when(F.contains(text, F.lit("|")), "table"),
        F.when(F.contains(text, F.lit("!!")), "shouting"), F.when(F.size(F.split(text, "\n")) == 1, "one_line"),
    )
    return table(spark, sf_dir, "documents").select(F.explode(F.array_compact(flags)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("""
SELECT k AS field, event_type, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL
""")
def field_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("field"))
    return keys.groupBy("field", "event_type").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)),
     m AS (SELECT count(*) AS n FROM (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS l_linenumber FROM lineitem GROUP BY l_orderkey
           EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem)),
     a AS (SELECT count(*) AS n FROM (SELECT l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS b FROM lineitem) WHERE l_linenumber <= b)
SELECT 'duplicate' AS kind, n FROM d UNION ALL SELECT 'missing', n FROM m UNION ALL SELECT 'not_ascending', n FROM a
""")
def id_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")]
    found = {
        "duplicate": quality.duplicates(lines, ["l_orderkey", "l_linenumber"]),
        "missing": quality.missing_ids(lines, ["l_orderkey"], "l_linenumber"),
        "not_ascending": quality.not_ascending(lines, ["l_orderkey"], order, "l_linenumber"),
    }
    out = None
    for kind, df in found.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, grouping(source, lang) AS level
FROM documents GROUP BY ROLLUP (source, lang)
""")
def volume_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.grouping_id("source", "lang").alias("level"))
    return rolled.withColumn("source", F.coalesce("source", F.lit("all"))).withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("""
WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), s AS (SELECT event_id AS sid, user_id, ts FROM events WHERE event_type = 'signup')
SELECT event_id, (SELECT arg_max(sid, struct_pack(t := s.ts, i := sid)) FROM s WHERE s.user_id = e.user_id AND s.ts < e.ts) AS previous,
       (SELECT arg_min(sid, struct_pack(t := s.ts, i := sid)) FROM s WHERE s.user_id = e.user_id AND s.ts > e.ts) AS next FROM e
""")
def neighbour_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the user's sign-ups right before and right after, by one sort of
    each user's events."""
    events = table(spark, sf_dir, "events").filter("event_type in ('error', 'signup')")
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    known = F.when(F.col("event_type") == "signup", F.col("event_id"))
    before = F.last(known, True).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, True).over(by_time.rowsBetween(1, Window.unboundedFollowing))
    return events.select("event_id", "event_type", before.alias("previous"), after.alias("next")).filter("event_type = 'error'").drop("event_type")


@query("""
SELECT DISTINCT c.conv_id, c.turn, c.role FROM conversations c JOIN conversations h ON h.conv_id = c.conv_id AND abs(c.turn - h.turn) <= 1 WHERE contains(lower(h.text), 'que')
""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.contains(F.lower("text"), F.lit("que"))
    return assembly.windows_around(table(spark, sf_dir, "conversations"), "conv_id", "turn", hit, 1).select("conv_id", "turn", "role")


@query("""
WITH a AS (SELECT doc_id, source, CASE WHEN instr(text, ' ') > 0 THEN left(text, instr(text, ' ') - 1) || '_' || substr(text, instr(text, ' ') + 1) ELSE text END AS t, instr(text, ' ') = 0 AS missed FROM documents),
     b AS (SELECT doc_id, CASE WHEN instr(t, 'the') > 0 THEN left(t, instr(t, 'the') - 1) || source || substr(t, instr(t, 'the') + 3) ELSE t END AS t, missed::INT + (instr(t, 'the') = 0)::INT AS n FROM a)
SELECT doc_id, md5(t) AS text, CAST(n AS INTEGER) AS n_missed FROM b
""")
def ordered_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two first-occurrence corrections per entry, in order; the second one's text is not
    in every entry."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    fix = lambda seq, old, new: F.struct(F.lit(seq).alias("seq"), F.lit(old).alias("old"), new.alias("new"))
    fixes = docs.select("doc_id", F.explode(F.array(fix(1, " ", F.lit("_")), fix(2, "the", F.col("source")))).alias("x"))
    done = assembly.corrected(docs, fixes.select("doc_id", "x.*"), "doc_id")
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "n_missed")


@query()
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every table that the corpus is built from, and its schema version."""
    out = None
    for name in ("documents", "labels", "conversations"):
        part = quality.digest(table(spark, sf_dir, name)).select(F.lit(name).alias("dataset"), F.lit("1").alias("schema_version"), "n_rows", "digest")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH n AS (SELECT doc_id, doc_id // 100 AS leaf, doc_id % 97 = 5 AS touched, doc_id % 113 = 7 AS gone FROM documents)
SELECT leaf * 100 AS low, leaf * 100 + 100 AS high, count(*) AS n_before, count(*) FILTER (NOT gone) AS n_now FROM n GROUP BY leaf HAVING bool_or(touched OR gone)
""")
def changed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of ids in which two builds of the corpus differ: rows changed, rows gone."""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    later = docs.filter(key % 113 != 7).withColumn("text", F.when(key % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return digests.changed(digests.tree(docs, "doc_id", 100), digests.tree(later.repartition(7), "doc_id", 100), 100)


@query("""
SELECT doc_id, md5(CASE WHEN length(text) > 90 THEN rtrim(substr(text, 1, 90)) || '……' ELSE text END) AS shown, length(text) > 90 AS cut,
       '第' || source || '，' || CAST(CAST(floor(n_chars / 1000) AS BIGINT) + 1 AS VARCHAR) || '、' || CAST(CAST(floor(n_chars / 1000) AS BIGINT) + 2 AS VARCHAR) AS citation,
       source || '：' || lang AS other FROM documents
""")
def projection_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated field, citation from volume and pages, unmapped labels as lines."""
    page = F.floor(F.col("n_chars") / 1000).cast("long") + 1
    pages = F.array_join(F.transform(F.array(page, page + 1), lambda p: p.cast("string")), "、")
    others = F.map_filter(F.create_map(F.col("source"), F.col("lang")), lambda k, v: F.length(v) > 0)
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(others)), lambda e: F.concat_ws("：", e["key"], e["value"])), "\n")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(X.truncated(F.col("text"), 90).cast("binary")).alias("shown"), (F.length("text") > 90).alias("cut"),
        F.concat_ws("，", F.concat(F.lit("第"), F.col("source")), pages).alias("citation"), lines.alias("other"),
    )
