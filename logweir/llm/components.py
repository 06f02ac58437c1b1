"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where(F.col("b") != F.col("m"))
    tied = rest.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)``: every node of ``edges (a, b)`` that is not the smallest of its component, with that.

    Sides must differ. No step gathers a node's neighbours: they are reduced to
    their smallest before the shuffle and met again by a join that the adaptive
    plan can split. Each round is checkpointed; rounds grow with the logarithm
    of the nodes.
    """
    edges = settle(edges.distinct())
    mark = None
    while True:
        edges = settle(_small_star(_large_star(edges)))
        row = F.xxhash64("a", "b")
        # Sums of the two halves of a hash: no overflow, and a change shows in one of them.
        now = edges.agg(
            F.count(F.lit(1)),
            F.sum(row.bitwiseAND(F.lit(0xFFFFFFFF))),
            F.sum(F.shiftrightunsigned(row, 32)),
        ).first()
        if now == mark:
            return edges
        mark = now
