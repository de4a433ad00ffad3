"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.storage import written


#: A node's links are dealt to so many parts, so the hub of a large component is no single key.
SALTS = 32


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least node around it: the greater ones, or the lesser ones and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = (both if large else both.where("b < a")).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    around = around.repartition("a", "salt")
    parts = around.groupBy("a", "salt").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    parts = parts.withColumn("m", F.min("m").over(Window.partitionBy("a")))
    linked = around.join(parts, ["a", "salt"])
    out = linked.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out if large else out.union(parts.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    return written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")


def _round(edges: DataFrame) -> DataFrame:
    return written(_star(_star(edges, large=True), large=False), "edges")


def _are_stars(edges: DataFrame) -> bool:
    """Does every node hang on one other that hangs on none? Then nothing can change any more."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes, after one round: most nodes hang on the least node around them."""
    return _round(_oriented(edges))


def labels(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the least node that each hangs on; the component itself once all edges are stars, else a part of it."""
    both = edges.select(F.col("a").alias("node"), "b").union(edges.select("b", "b"))
    return both.groupBy("node").agg(F.min("b").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its least node.

    An empty edge table gives an empty result; repeated edges, loops and either
    direction are alike. The loop ends when all edges are stars, which takes a
    number of rounds that grows with the logarithm of the nodes.
    """
    now = _oriented(edges)
    while not _are_stars(now):
        now = _round(now)
    return labels(now)
