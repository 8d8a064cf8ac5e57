"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, edit_counts, filter_audit, mixing, ngram_lm, quality, quality_classifier, repeats, simhash, sketches, token_files, toxicity
from .common import documents, fold, text_or_empty

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _sha(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        _sha("decoded").alias("decoded_sha256"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER)
    return token_files.read_documents(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, fold("doc_id", 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words=3, radius=3)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_sketch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_with_edit(documents(spark, sf_dir))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every text: words struck out a quarter in, the text's own
    beginning put in at the middle, a closing line appended."""
    text = text_or_empty("text")
    n = F.length(text)
    edit = lambda place, delete, insert: F.struct(place.cast("int").alias("place"), F.lit(delete).alias("delete"), insert.alias("insert"))
    edits = F.array(
        edit(F.floor(n / 4), 25, F.lit("")),
        edit(F.floor(n / 2), 3, F.substring(text, 1, 40)),
        edit(F.lit(2**31 - 1), 0, F.lit("\nRevised and checked.")),
    )
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("edits", edits)
    return edit_counts.count_edits(docs, TOKENIZER)


#: Wanted shares of the tokens of low (0) and high (1) quality.
MIXTURE = {"0": 0.05, "1": 0.95}


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text"), labels, MIXTURE)
    return mixed.select("doc_id", "tokens", F.round(F.get("p", F.lit(1)), 9).alias("high_quality"), F.round("rate", 6).alias("rate"), "copies")


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(documents(spark, sf_dir).select("doc_id", "text"), depth=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op10_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold("doc_id", 10) == 0).alias("held_out"))
    scored = ngram_lm.score(docs, F.col("held_out"))
    return scored.select(
        "doc_id", "held_out", F.col("n_tokens").cast("long"), F.col("n_known").cast("long"), "train_tokens", "base_score", "score"
    )


def op11_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_classifier.fit(docs, labels, fold("doc_id", 5) != 0)
    return quality_classifier.score(docs, model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    words = quality.words_of(text)
    without = lambda signs: F.length(F.translate(text, signs, ""))
    filters = {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long") > 5 * F.length(text).cast("long"),
        "D": F.length(text) > without("#$%&*|"),
    }
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit(documents(spark, sf_dir), labels, filters, twin="E")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are damaged first, by a checksum of their ids."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    damaged = marked.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), times.alias("time"))
    return conversation_repair.repair(damaged, present=F.col("present"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_encode_decode": op1_bpe_encode_decode,
        "op2_toxicity": op2_toxicity,
        "op3_simhash_components": op3_simhash_components,
        "op4_sketch_fingerprints": op4_sketch_fingerprints,
        "op5_token_files": op5_token_files,
        "op6_line_quality": op6_line_quality,
        "op7_edit_aware_counts": op7_edit_aware_counts,
        "op8_soft_mixing": op8_soft_mixing,
        "op9_repeated_bytes": op9_repeated_bytes,
        "op10_log_frequency_bloom": op10_log_frequency_bloom,
        "op11_subword_quality": op11_subword_quality,
        "op12_filter_audit": op12_filter_audit,
        "op13_conversation_repair": op13_conversation_repair,
    }


OP12_SQL = r"""
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), known as (
  select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id
), failing as (
  select part, len(words) < 50 as a, 100 * list_unique(words) < 65 * len(words) as b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d, coalesce(texts.doc_id > min(texts.doc_id) over (partition by text), false) as e,
    coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic
  from texts left join known on texts.doc_id = known.doc_id
), masks as (
  select part, a, b, c, d, e, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failing group by all
), letters(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')), orders as (
  select concat(v.f, w.f, x.f, y.f, z.f) as filter_order from letters v, letters w, letters x, letters y, letters z
  where len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5
), gone as (
  select m.*, filter_order, least(if(a, strpos(filter_order, 'A'), 9), if(b, strpos(filter_order, 'B'), 9), if(c, strpos(filter_order, 'C'), 9),
    if(d, strpos(filter_order, 'D'), 9), if(e, strpos(filter_order, 'E'), 9)) as gone
  from masks m, orders
), stepped as (
  select *, filter_order[step] as f, case filter_order[step] when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as fails,
    a::int + b::int + c::int + d::int + e::int as failed
  from gone, (values (1), (2), (3), (4), (5)) s(step)
), summed as (
  select part, filter_order, step, f, sum(if(gone > step, n, 0)) as kept, sum(if(gone = step, n, 0)) as removed, sum(if(fails and gone < step, n, 0)) as redundant,
    sum(if(fails and failed = 1, n, 0)) as unique_fails, sum(if(gone = step, good, 0)) as good_lost, sum(if(gone = step, toxic, 0)) as toxic_lost
  from stepped group by all
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, sum(removed) over (partition by part, f)::bigint as shapley
from summed
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_audit": OP12_SQL}
