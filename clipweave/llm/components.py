"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import keep


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the smallest node around.  Hubs are safe: the minimum is combined map-side."""
    if small:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = edges.union(edges.select("b", "a")).toDF("u", "v")
    lowest = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    hung = around.join(lowest, "u")
    pairs = hung.where(F.col("v") > F.col("u")).select("v", "low") if not small else (
        hung.select("v", "low").union(lowest.select("u", "low"))
    )
    return pairs.toDF("a", "b").where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (a > b) are stars: every a hangs on one b, and no b hangs on anything."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("root").alias("root"))
    return not sums.where("ups > 1 or (ups = 1 and root = 1)").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; a component is named by its smallest node.

    ``edges`` is read twice, so pass a written table.  Each round is a few joins and sums over the
    edges, which are written to the shared folder; rounds grow with the logarithm of the longest
    path.  Nodes without edges do not appear; edges in either direction or repeated count once.
    """
    edges = edges.select("a", "b").where("a <> b")
    for _ in range(max_rounds):
        edges = keep(_star(keep(_star(edges, False), "large"), True), "small")
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def merged(first: DataFrame, more: DataFrame) -> DataFrame:
    """``first (node, component)`` after the edges ``more (a, b)`` have joined some of its components.

    Only the contracted edges between components are worked on.  Nodes of ``more`` that ``first``
    lacks count as components of their own, and appear in the result.
    """
    name = lambda s: first.select(F.col("node").alias(s), F.col("component").alias(f"{s}_in"))
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
        F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")
    )
    top = keep(components(keep(between, "between")), "top").toDF("component", "_top")
    lone = top.select(F.col("component").alias("node"), "component").join(first, "node", "left_anti")
    every = first.select("node", "component").union(lone)
    return every.join(top, "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
