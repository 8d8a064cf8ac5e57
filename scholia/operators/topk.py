"""The best entries of each query without scoring all that match.

Postings are kept in blocks of entries of like length with the largest contribution that any
of them can make.  What a block's maxima add up to bounds every score in it.  A first pass
scores the most promising blocks of each query, which hold as many entries as are wanted;
the last of these scores is a threshold, and only blocks whose bound reaches it are read
after that.  The result is that of scoring everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .search import B, K1, LEAST_IDF, best_ranked

#: Entries of a block, about; classes of length for each doubling; scores closer than this are ties.
BLOCK, CLASSES, TIE = 32, 8, 1e-6


def impact_blocks(postings: DataFrame, lengths: DataFrame, weights: dict[str, float], size_of_block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, frequencies) of postings (token, field, id, tf) and lengths (id, n_tokens):
    blocks have token, block, most, n and their posts (id, impact), ``size_of_block`` of them about."""
    size = lengths.agg(F.count("*"), F.avg("n_tokens")).first()
    # impact falls with length, so that a block of long entries has a low bound
    kind = F.floor(CLASSES * F.log2(1.0 + F.col("n_tokens"))).cast("int")
    kinds = lengths.groupBy(kind.alias("kind")).agg(F.ceil(F.count("*") / size_of_block).alias("blocks")).collect()  # CLASSES for each doubling of length
    blocks_of = F.element_at(F.create_map(*(F.lit(x) for r in kinds for x in (r.kind, r.blocks))), kind) if kinds else F.lit(1)
    lengths = lengths.withColumn("block", F.shiftleft(kind.cast("long"), 40) + F.pmod(F.xxhash64("id"), blocks_of))
    weight = F.element_at(F.create_map(*(F.lit(x) for f, w in weights.items() for x in (f, float(w)))), F.col("field"))
    tf = postings.filter(F.col("field").isin(list(weights))).groupBy("token", "id").agg(F.sum(F.col("tf") * weight).alias("tf"))
    norm = 1 - B + B * F.col("n_tokens") / F.lit(size[1] or 1.0)
    posts = tf.join(lengths, "id").select("token", "id", "block", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)).alias("impact"))
    blocks = posts.groupBy("token", "block").agg(F.max("impact").alias("most"), F.count("*").alias("n"), F.collect_list(F.struct("id", "impact")).alias("posts"))
    blocks = stored(blocks.sortWithinPartitions("token"))
    held = blocks.groupBy("token").agg(F.sum("n").alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(size[0]) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return blocks, held.select("token", idf.alias("idf"))


def best(blocks: DataFrame, frequencies: DataFrame, tokens: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((query, id, score, rank) of the best ``k`` of each query for ``tokens`` (query, token),
    one row with the blocks that matched and those that were read)."""
    asked = stored(tokens.distinct().join(frequencies, "token"))
    met = asked.join(blocks.select("token", "block", "most", "n"), "token")
    bounds = stored(met.groupBy("query", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"), F.max("n").alias("n")))
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    # a block has at least as many matches as its commonest token has entries there
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = stored(bounds.withColumn("before", before).filter(F.col("before") < k).select("query", "block"))

    def scored(wanted: DataFrame) -> DataFrame:
        read = asked.join(blocks, "token").join(wanted, ["query", "block"], "left_semi")
        return read.select("query", "idf", F.explode("posts").alias("p")).groupBy("query", "p.id").agg(F.sum(F.col("idf") * F.col("p.impact")).alias("score"))

    ranking: list[Column] = [F.desc(F.round("score", 6)), F.col("id")]
    start = stored(scored(first))
    least = best_ranked(start, ["query"], ranking, k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("query", "least")
    open_ = bounds.join(first, ["query", "block"], "left_anti").join(least, "query", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - TIE))
    open_ = stored(open_.select("query", "block"))
    top = best_ranked(start.unionByName(scored(open_)), ["query"], ranking, k)
    matched, read = bounds.agg(F.count("*").alias("matched")), first.unionByName(open_).agg(F.count("*").alias("read"))
    return top, matched.join(read)  # one row each
