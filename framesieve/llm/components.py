"""Connected components of a link table, by alternating large and small stars.

Every step is a grouped minimum and a join; nothing gathers a component.  A node with very many links is a skewed join
key, which adaptive execution splits.  Each round is stored, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours go to its least neighbour; small star: its smaller ones do."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    moved = both.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own)
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for each node that has a link; edges needs long a and b."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    mark = None
    for _ in range(most_rounds):
        edges = stored(_star(_star(edges, True), False), "links")
        seen = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        if mark == (seen.n, seen.h):
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
