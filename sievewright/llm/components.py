"""Connected components of an edge table by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import cut


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the least of the node and its neighbours."""
    both = _neighbours(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the distinct edges (u, v), u > v, are stars already: no node has two smaller neighbours, or one on
    either side."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").isEmpty()


def contract(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, with the same components and, at the end, one star for each.

    With ``most_rounds`` the contraction may stop early; what is joined is still connected.
    """
    stars = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    rounds = 0
    while rounds != most_rounds and not _settled(stars):
        stars, rounds = cut(_small_star(_large_star(stars))), rounds + 1
    return stars


def labels(stars: DataFrame) -> DataFrame:
    """(node, label) for every node with a smaller neighbour; after full contraction, the least node."""
    return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
