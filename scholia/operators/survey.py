"""Questionnaires: scoring of answers in two dimensions, outlines of answer paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores up to and including each bound make levels 1, 2, 3, 4 and 5.
LEVEL_BOUNDS = (3.0, 6.0, 9.0, 12.0, 1e9)

#: Fixed value: score of each level-0 answer.
LEVEL0 = 0.3


def base_score(level: Column, kind: Column) -> Column:
    """3L for defining answers, 3L - 2 for one of several; 0 at level 0."""
    return F.when(level == 0, 0).when(kind == "one_of", 3 * level - 2).otherwise(3 * level)


def level_of(score: Column, bounds: tuple[float, ...] = LEVEL_BOUNDS) -> Column:
    """The bucket (low, high] of a score; 0 for no score."""
    out = F.lit(len(bounds))
    for i, high in reversed(list(enumerate(bounds, 1))):
        out = F.when(score <= high, i).otherwise(out)
    return F.when(score <= 0, 0).otherwise(out)


def scores(answers: DataFrame, person: str = "person") -> DataFrame:
    """(person, first, second, first_level, second_level) from answers (person,
    dimension first|second, level, kind defining|one_of).

    Three aggregations: answers of a kind, the best kind of a level, all levels."""
    kinds = answers.groupBy(person, "dimension", "level", "kind").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("points", base_score(F.col("level"), F.col("kind")) + F.col("n") - 1)
    levels = kinds.groupBy(person, "dimension", "level").agg(
        F.max("points").alias("points"), F.coalesce(F.sum(F.when(F.col("kind") == "defining", F.col("n"))), F.lit(0)).alias("n_defining")
    )
    above = F.col("level") > 0
    whole = levels.groupBy(person, "dimension").agg(
        F.sum(F.when(above, F.col("points"))).alias("n"), F.sum(F.when(above, 3 * F.col("level"))).alias("m"), F.max(F.when(above, F.col("points"))).alias("x"),
        F.coalesce(F.sum(F.when(~above, F.col("n_defining"))), F.lit(0)).alias("zero"),
    )
    score = F.coalesce(F.col("n") / F.col("m") * F.col("x"), F.lit(0.0))
    pick = lambda c, d: F.coalesce(F.sum(F.when(F.col("dimension") == d, c)), F.lit(0.0))
    wide = whole.groupBy(person).agg(*(pick(c, d).alias(f"{d}_{n}") for d in ("first", "second") for n, c in (("score", score), ("zero", LEVEL0 * F.col("zero")))))
    a, b = F.col("first_zero"), F.col("second_zero")
    first = F.col("first_score") + F.when(a == b, a).when(a > b, a + b).otherwise(0)
    second = F.col("second_score") + F.when(a == b, b).when(a > b, 0).otherwise(a + b)
    out = wide.select(person, F.round(first, 6).alias("first"), F.round(second, 6).alias("second"))
    return out.select("*", level_of(F.col("first")).alias("first_level"), level_of(F.col("second")).alias("second_level"))


def first_seen(steps: DataFrame, person: str, node: str, order: list[Column]) -> DataFrame:
    """Of all rows that lead to the same node for a person, the first."""
    seen = Window.partitionBy(person, node).orderBy(*order)
    return steps.withColumn("__seen", F.row_number().over(seen)).filter("__seen = 1").drop("__seen")


def outline_rows(lines: DataFrame, doc: str = "doc_id", place: str = "line_no", text: str = "text") -> DataFrame:
    """Question rows of outline documents: number, level, parent place, title, marks.

    A line's parent is the last line before it of a lower level in its document."""
    from ..functions import text as X

    numbered = lines.withColumn("level", X.outline_level(F.col(text))).filter("level is not null")
    before = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    held = [F.last(F.when(F.col("level") == i, F.col(place)), True).over(before) for i in range(4)]
    numbered = numbered.select("*", *(h.alias(f"__p{i}") for i, h in enumerate(held)))
    # of the levels below one's own, the latest line
    parent = F.when(F.col("level") > 0, F.greatest(*(F.when(F.col("level") > i, F.col(f"__p{i}")) for i in range(4))))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), r"[(（][^()（）]*[)）]", ""), r"^\s*([一二三四五六七八九十]+、|\d+(\.\d+)+)", ""))
    return numbered.select(doc, place, "level", parent.alias("parent"), title.alias("title"), X.annotations(F.col(text)).alias("marks"), X.options(F.col(text)).alias("options"))


def between_exclusions(nodes: DataFrame, titles: tuple[str, ...]) -> DataFrame:
    """(id, clear_ids): a "nothing of this" node (one of the titles) clears every id between
    its parent's and its own, and each of those clears it.  ``nodes`` is (id, parent_id,
    title); ids between two nodes are enumerated and met by equality."""
    none = nodes.filter(F.col("title").isin(*titles) & (F.col("parent_id") < F.col("id") - 1))
    inside = none.select(F.col("id").alias("none_id"), F.explode(F.sequence(F.col("parent_id") + 1, F.col("id") - 1)).alias("id"))
    pairs = inside.join(nodes.select("id"), "id")
    clears = pairs.groupBy(F.col("none_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("clear_ids"))
    cleared = pairs.groupBy("id").agg(F.array(F.max("none_id")).alias("clear_ids"))
    return clears.unionByName(cleared.join(clears.select("id"), "id", "left_anti"))


def sibling_exclusions(branches: DataFrame, parent: str, branch: str, key: str) -> DataFrame:
    """``branches`` (parent, branch, id) with clear_ids: the ids of all other branches of the
    same parent; a parent's options are few."""
    whole = F.collect_list(F.struct(branch, key)).over(Window.partitionBy(parent))
    others = F.transform(F.filter("__all", lambda x: x[branch] != F.col(branch)), lambda x: x[key])
    return branches.withColumn("__all", whole).withColumn("clear_ids", F.array_sort(others)).drop("__all")
