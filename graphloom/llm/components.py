"""Connected components of an edge table by alternating large and small stars.

No step gathers a component, a neighbourhood or an edge list in one task: each is a min per
node (combined before the shuffle) joined back, with the rows of a node of many edges dealt to
many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, hot_join, materialize, narrow

#: Edges for one task.
EDGES = 100_000


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return hot_join(both.filter("v > u"), low, ["u"], "v", rows, "inner").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    # edges have a < b: every b links its smaller neighbours and itself to the smallest of them
    low = e.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
    moved = hot_join(e, low, ["b"], "a", rows, "inner").filter("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return low.select(F.col("m").alias("x"), F.col("b").alias("y")).unionByName(moved).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _all_stars(e: DataFrame) -> bool:
    """Whether no node is a centre and a leaf at once, or a leaf twice."""
    roles = e.select(F.col("a").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")))
    return roles.groupBy("node").agg(F.max("centre").alias("c"), F.sum("leaf").alias("l")).filter("(c = 1 and l > 0) or l > 1").isEmpty()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    Null ends and self-links are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    e = materialize(e, "cc")
    most = 2 * e.count()
    for _ in range(max_rounds):
        if _all_stars(e):
            break
        n = materialize(narrow(_small_star(_large_star(e, most), most), most, EDGES), "cc")
        drop(e)
        e = n
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    stars = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def near_labels(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes with a smaller neighbour: one they can reach, often the smallest.

    Edges have a < b. One step to the smallest neighbour and two jumps, not repeated until nothing
    changes: nodes with equal labels are connected, while connected nodes may differ in their labels.
    """
    low = materialize(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "low")
    rows = low.count()
    step, out = low.select(F.col("node").alias("component"), F.col("component").alias("c")), low
    for _ in range(2):
        uses = out.groupBy("component").agg(F.count("*").alias("n"))
        out = hot_join(out, uses.join(step, "component", "left"), ["component"], "node", rows).select("node", F.coalesce("c", "component").alias("component"))
    return out
