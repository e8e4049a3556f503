"""Connected components by alternating large and small stars, with every round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a, b): neighbours move to the least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    moved = both.join(least, "u")
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("least").alias("b")).union(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
    return moved.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its least node.

    edges has the columns a and b of one type; loops, repeated edges and nulls are ignored.
    """
    now = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        after = staged(_star(_star(now, True), False), "edges")
        told = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if tuple(told) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        mark = tuple(told)
