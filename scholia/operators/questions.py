"""The question bank as a tree: titles above a question, options below it, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import chains

#: Fixed value: the number that a title begins with.
NUMBER = r"^([一二三四五六七八九十\d.]+)"


def titles_above(nodes: DataFrame) -> DataFrame:
    """(id, place, above): for each question its parent's title (place 0), then for every
    shorter prefix of its number, longest first, the first level-1 title before it that
    begins so.  ``nodes`` is (id, parent_id, title, level, ord); titles are kept distinct
    by number, so a question meets the titles under its own prefixes alone."""
    number = F.regexp_extract("title", NUMBER, 1)
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("title").alias("above"))
    first = nodes.join(parents, "parent_id").select("id", F.lit(0).alias("place"), "above")
    parts = F.split(number, r"\.")
    deep = nodes.select("id", "ord", parts.alias("parts")).filter(F.size("parts") >= 3)
    wanted = deep.select("id", "ord", F.col("parts"), F.explode(F.sequence(F.lit(1), F.size("parts") - 2)).alias("place"))
    wanted = wanted.withColumn("prefix", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - F.col("place")), "."))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(number))), lambda i: F.substring("title", F.lit(1), i)))
    heads = nodes.filter("level = 1").select(F.col("title").alias("above"), F.col("ord").alias("head_ord"), F.col("id").alias("head_id"), cut.alias("prefix"))
    met = wanted.join(heads, "prefix").filter("head_ord < ord")
    nearest = met.groupBy("id", "place").agg(F.min_by("above", F.struct("head_id")).alias("above"))
    return first.unionByName(nearest)


def walk(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, path, has_children, place): options below each root in reading order, going
    down only through headings (mode -1), however deep.  ``nodes`` is (id, parent_id, ord,
    mode), ``roots`` (root); ``path`` holds (ord, id) of each step and sorts the walk.  Options
    that go round in circles are below no root."""
    nodes = nodes.select("id", "parent_id", "ord", "mode")
    parents = nodes.select(F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))
    step = F.struct(F.col("ord").cast("long").alias("ord"), F.col("id").cast("long").alias("id"))
    # upwards: from an option to its parent, and on from there only if that is a heading
    onward = F.when(F.col("mode") == -1, F.col("parent_id"))
    up = chains(nodes.select("id", onward.alias("up"), step.alias("step"))).select(F.col("id").alias("parent_id"), F.col("chain").alias("above"), (F.col("state") == "cycle").alias("rings"))
    own = nodes.join(up, "parent_id", "left").filter("not coalesce(rings, false)").select("id", "parent_id", F.concat(F.coalesce("above", F.array(F.struct(F.lit(None).cast("long").alias("ord"), F.col("parent_id").cast("long").alias("id")))), F.array(step)).alias("chain"))
    # every node of a chain may be a root; what a chain's top hangs on may be one, too
    top = nodes.select(F.col("id").cast("long").alias("top"), F.when(F.col("mode") == -1, F.col("parent_id")).cast("long").alias("hung"))
    own = own.withColumn("top", F.get("chain", F.lit(0))["id"]).join(top, "top", "left")
    outside = F.when(F.col("hung").isNotNull(), F.array(F.struct(F.lit(None).cast("long").alias("ord"), F.col("hung").alias("id")))).otherwise(F.slice("chain", 1, 0))
    own = own.withColumn("chain", F.concat(outside, "chain"))
    found = own.select("id", "chain", F.posexplode(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("at", "over")).join(roots.distinct(), F.col("over.id") == F.col("root"))
    walked = found.select("root", "id", F.slice("chain", F.col("at") + 2, F.size("chain")).alias("path")).join(parents, "id", "left")
    place = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    return walked.select("root", "id", "path", F.coalesce("has_children", F.lit(False)).alias("has_children"), place.alias("place"))


def listing(answers: DataFrame, group: list[str], path: str, key: str) -> DataFrame:
    """Answers in the order of their paths (compared number by number), then of their ids."""
    return answers.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(path, key)))


def result_text(first: Column, second: Column) -> Column:
    """Both levels as the sentence that is stored with a visit."""
    return F.format_string("焦虑%d级(A%d)     抑郁%d级(B%d)。", first, first, second, second)


def digits_of(text: Column) -> Column:
    """All numbers of a stored result."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
