"""Batch twins of the streams: what the protocols leave behind over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table


@query("""
WITH e AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS seq, event_type = 'purchase' AS closing FROM events),
     a AS (SELECT *, seq > coalesce(max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM e),
     c AS (SELECT user_id, min(event_id) FILTER (fresh AND closing) AS closed_at FROM a GROUP BY user_id)
SELECT user_id, max(seq) FILTER (fresh AND (closed_at IS NULL OR event_id <= closed_at)) AS sequence, count(*) FILTER (fresh AND (closed_at IS NULL OR event_id <= closed_at)) AS n_accepted,
       count(*) FILTER (closed_at IS NOT NULL AND event_id > closed_at) AS n_after_close, count(*) AS n FROM a JOIN c USING (user_id) GROUP BY user_id
""")
def snapshot_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of a recording (user): larger sequences win until an accepted close."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("seq"), (F.col("event_type") == "purchase").alias("closing"))
    order = Window.partitionBy("user_id").orderBy("event_id")
    fresh = F.col("seq") > F.coalesce(F.max("seq").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    rows = rows.withColumn("fresh", fresh)
    closed = F.min(F.when(F.col("fresh") & F.col("closing"), F.col("event_id"))).over(Window.partitionBy("user_id"))
    rows = rows.withColumn("closed_at", closed)
    late = F.coalesce(F.col("event_id") > F.col("closed_at"), F.lit(False))
    kept = F.col("fresh") & ~late
    return rows.groupBy("user_id").agg(F.max(F.when(kept, F.col("seq"))).alias("sequence"), F.count_if(kept).alias("n_accepted"), F.count_if(late).alias("n_after_close"), F.count("*").alias("n"))


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS k, first_value(l_partkey) OVER w AS held FROM lineitem
           WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice))
SELECT l_orderkey, count(*) FILTER (k = 1) AS n_chunks, count(*) FILTER (k > 1 AND l_partkey = held) AS n_repeats, count(*) FILTER (k > 1 AND l_partkey <> held) AS n_conflicts,
       max(l_linenumber) = count(*) FILTER (k = 1) AS contiguous FROM o GROUP BY l_orderkey
""")
def chunk_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a recording (order): the first of a number is held, equal ones repeat it,
    others conflict; the numbers should run without a gap."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("k"), F.first("l_partkey").over(w).alias("held"))
    first, same = F.col("k") == 1, F.col("l_partkey") == F.col("held")
    return rows.groupBy("l_orderkey").agg(
        F.count_if(first).alias("n_chunks"), F.count_if(~first & same).alias("n_repeats"), F.count_if(~first & ~same).alias("n_conflicts"),
        (F.max("l_linenumber") == F.count_if(first)).alias("contiguous"),
    )


@query("""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS stage, value > 250 AS edit FROM events),
     s AS (SELECT user_id, unnest(range(0, 5)) AS slot FROM (SELECT DISTINCT user_id FROM e)),
     f AS (SELECT s.user_id, slot, coalesce(max(event_id) FILTER (NOT edit AND stage = slot) > coalesce(max(event_id) FILTER (edit AND stage <= slot), -1), false) AS confirmed FROM s JOIN e USING (user_id) GROUP BY ALL)
SELECT user_id, string_agg(CASE WHEN confirmed THEN '1' ELSE '0' END, '' ORDER BY slot) AS confirmed, (SELECT count(*) FROM events v WHERE v.user_id = f.user_id) AS version FROM f GROUP BY user_id
""")
def action_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five confirmation slots of an encounter (user): an edit at a stage clears its slot
    and all later ones, so a slot holds if its last confirmation came after them."""
    stage = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 3).otherwise(4)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", stage.alias("stage"), (F.col("value") > 250).alias("edit"))
    last = lambda c: F.max(F.when(c, F.col("event_id")))
    sums = [last(~F.col("edit") & (F.col("stage") == i)).alias(f"c{i}") for i in range(5)] + [last(F.col("edit") & (F.col("stage") <= i)).alias(f"e{i}") for i in range(5)]
    folded = rows.groupBy("user_id").agg(F.count("*").alias("version"), *sums)
    held = (F.when(F.col(f"c{i}") > F.coalesce(F.col(f"e{i}"), F.lit(-1)), "1").otherwise("0") for i in range(5))
    return folded.select("user_id", F.concat(*held).alias("confirmed"), "version")


@query("""
SELECT time_bucket(INTERVAL 10 SECOND, ts) AS slot, count(*) AS n FROM events GROUP BY ALL
""")
def fixed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in tumbling slots of ten seconds."""
    slots = table(spark, sf_dir, "events").groupBy(F.window("ts", "10 seconds").alias("w")).agg(F.count("*").alias("n"))
    return slots.select(F.col("w.start").alias("slot"), "n")
