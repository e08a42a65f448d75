"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrace.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``a, b`` (longs) to ``node, root``: the smallest node each node is connected with; roots themselves are left out.

    Alternating large-star and small-star steps, each a min per node (combined before the shuffle) and a
    join whose sides AQE can split, until the edges stay as they are. Every step's edges are written, so
    a lost executor costs one step.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark, step = scratch.keep(edges, f"{name}0"), None, 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = scratch.keep(_star(both, F.col("b") > F.col("a")), f"{name}{step}large")
        small = scratch.keep(_star(edges, F.lit(True)), f"{name}{step}small")
        scratch.drop(f"{name}{step}large", f"{name}{step}")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.xxhash64("b", "a") % 999983)).first()
        if now == mark:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        step, mark = step + 1, now
        scratch.drop(f"{name}{step}")
        edges = scratch.keep(small, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}small")


def _star(edges: DataFrame, which) -> DataFrame:
    """Ties the neighbours of each node to the least of them and the node itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).select(F.struct("a").alias("at"), F.least("a", "least").alias("least"))
    tied = edges.where(which).select(F.struct("a").alias("at"), "b").join(least, "at").select(F.col("b").alias("x"), F.col("least").alias("y"))
    tied = tied.union(least.select(F.col("at.a").alias("x"), F.col("least").alias("y")))
    return tied.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
