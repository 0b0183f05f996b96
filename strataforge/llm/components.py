"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame) -> DataFrame:
    """Large star, then small star: edges (a, b) with a > b, the same components, fewer levels."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    # every node keeps the edge to its least neighbour
    large = large.unionByName(least.where("k > m").select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    small = large.join(low, F.col("a") == F.col("k")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Edges (a, b) of comparable non-null values -> (node, root): root is the smallest value reachable from node.

    Only nodes that are not their own root are listed. Direction, repeats and loops of edges do not matter. Each round is
    written to the shared folder; nodes are never gathered. Every message of a round is a node and its least neighbour, so
    a node with very many edges costs its edges once, split by skewed-join handling, and no task holds a component.
    """
    edges = common.materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = common.materialise(_stars(edges), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
