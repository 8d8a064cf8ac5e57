"""Connected components of an edge table, by contraction.

Each round every node hooks to its smallest neighbour if that is smaller, the
hooks are followed to their ends by pointer jumping, and the edges are redrawn
between the ends.  Only joins and aggregations run; every intermediate table is
written to the shared folder, and the driver learns counts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def _follow(hooks: DataFrame) -> DataFrame:
    """Replace each node's hook by the end of its chain."""
    while True:
        further = hooks.select(F.col("node").alias("goal"), F.col("goal").alias("next"))
        stepped = materialised(
            hooks.join(further, "goal", "left").select("node", F.coalesce("next", "goal").alias("goal"), F.col("next").isNotNull().alias("moved"))
        )
        if stepped.filter("moved").isEmpty():
            return stepped.select("node", "goal")
        hooks = stepped.select("node", "goal")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node on an edge; root is the smallest node reachable.

    Loops, repeated edges and edges with a null end are allowed; the latter are
    no edges.  An empty table gives an empty one.
    """
    x, y = F.col(a), F.col(b)
    edges = materialised(
        edges.filter(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("high"), F.least(x, y).alias("low")).distinct()
    )
    roots = edges.select(F.explode(F.array("high", "low")).alias("node")).distinct().withColumn("root", F.col("node"))
    edges = edges.filter("high <> low")
    while not edges.isEmpty():
        hooks = _follow(edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("goal")))
        root = hooks.select(F.col("node").alias("root"), "goal")
        roots = materialised(roots.join(root, "root", "left").select("node", F.coalesce("goal", "root").alias("root")))
        high, low = (hooks.select(F.col("node").alias(c), F.col("goal").alias(f"{c}_goal")) for c in ("high", "low"))
        ends = [F.coalesce(f"{c}_goal", c) for c in ("high", "low")]
        edges = materialised(
            edges.join(high, "high", "left")
            .join(low, "low", "left")
            .select(F.greatest(*ends).alias("high"), F.least(*ends).alias("low"))
            .filter("high <> low")
            .distinct()
        )
    return roots
