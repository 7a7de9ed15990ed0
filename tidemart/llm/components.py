"""Connected components of a distributed edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import checkpointed, freed_shuffles


def _stars(edges: DataFrame) -> DataFrame:
    """Both steps on edges (a, b) with a > b: larger neighbours, then smaller ones, move to the smallest one."""
    ends = edges.union(edges.select("b", "a"))
    least = ends.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    large = ends.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    least = large.groupBy("a").agg(F.min("b").alias("least"))
    small = large.join(least, "a")
    moved = small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(small.select("a", "least")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of its component.

    Every round hangs each node's larger neighbours, and then its smaller ones, under its smallest neighbour,
    until nothing moves; the rounds grow with the logarithm of the number of nodes. Edges stay distributed and
    are checkpointed; the neighbours of one node are never gathered.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    left, before = checkpointed(pairs), None
    while True:
        with freed_shuffles(edges.sparkSession):
            state = left.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        left = checkpointed(_stars(left))
    roots = left.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return left.toDF("node", "root").union(roots)
