"""Connected components by alternating stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitloom.llm.common import kept


def _large_stars(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to one row (a, b) per node that is not a root: b is the least node of its component.

    Nodes are longs; loops are ignored. Every round rewrites the edges as two kinds
    of stars until nothing changes, which takes logarithmically many rounds. A round
    groups with partial minima, and its joins can be split at hot nodes.
    """
    now = kept(edges.where("a != b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before or not state.n:
            return now
        before = state
        now = kept(_small_stars(_large_stars(now)), "stars")
