"""The corpus pipeline: raw documents to encoded training text, stage by stage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet in the shared folder and reads them back for the next.
All stages but the last return the columns of ``documents``.

Null texts count as empty and are kept; columns besides those of ``documents``, whatever
their names, pass through the first four stages in one struct, so that no operator's own
columns meet them; null ids are scored, deduplicated by text and never learned
from; equal rows and equal texts leave one row, that with the smallest id; very long texts
go through every stage whole; an empty table runs through to an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import bpe, mixing, near_copies, repeats, toxicity
from scholia.llm.common import documents, fold, materialised, text_or_empty
from scholia.llm.queries import MIXTURE, TOKENIZER

#: A document scored so high is dropped.
TOXIC = 0.7

#: Words of a shingle; views of 64 bits; differing bits up to which documents are proposed
#: as near copies, in one view and over all.  What links them is verified: a Jaccard index
#: of near_copies.NUM / near_copies.DEN.
SHINGLE, VIEWS, RADIUS, LIMIT = 5, 2, 3, 26


#: Columns of documents, and the one that holds all others inside a stage.
COLUMNS, CARRIED = ("doc_id", "text", "lang", "source", "n_chars"), "carried"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """The stage with all columns that are not those of documents as one struct."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        further = [c for c in docs.columns if c not in COLUMNS]
        if not further:
            return stage(spark, docs, sf_dir)
        packed = F.struct(*(F.col(f"`{c}`") for c in further)).alias(CARRIED)
        out = stage(spark, docs.select(*(c for c in docs.columns if c in COLUMNS), packed), sf_dir)
        return out.select(*(F.col(f"{CARRIED}.`{c}`").alias(c) if c in further else F.col(c) for c in docs.columns))

    return run


@carrying
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, fold("doc_id", 3) != 1)
    return toxicity.score(docs, model, out="__score").filter(F.col("__score") < TOXIC).drop("__score")


@carrying
def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents link from a shingle Jaccard index of 0.8 on; the row with the smallest id
    of each group stays."""
    text_hash = F.xxhash64(text_or_empty("text"))
    grouped = near_copies.groups(docs, SHINGLE, VIEWS, RADIUS, LIMIT)
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("th"))
    stay = grouped.groupBy("near").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("stay_id"), F.col("first.th").alias("stay_th"))
    keyed = docs.withColumn("__th", text_hash)
    same = F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("__th") == F.col("stay_th"))
    # equal rows share id and text: one of them stays
    return keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", "__th"]).drop("__th")


@carrying
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(docs, characters=True).withColumn("text", F.col("kept_bytes").cast("string"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@carrying
def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixture, members = mixing.fit(docs, labels, MIXTURE, keep_text=True)
    # written out first: a filter on the copies, pushed below, would repeat the whole classifier
    rated = materialised(mixture.with_rates(members, "doc_id").select(*docs.columns, F.col("copies").alias("__copies")))
    drawn = rated.filter(F.col("__copies") > 0)
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids, and whether they decode to the text."""
    decoded = bpe.round_trip(docs, TOKENIZER)
    same = F.col("decoded") == text_or_empty("text")
    return decoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_copies),
    ("suffix_array_dedup", remove_repeated_passages),
    ("mixing_to_weights", mix_to_weights),
    ("bpe_encode_decode", encode_text),
]

#: The stages learn models and group by fingerprint distance, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir))
    return docs
