"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node near it."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Per node of ``links``: member, component (the smallest node that it is connected with).

    Each round is written to the shared folder and read again, so lineage stays short. The rounds end when the edges
    are stars around their smallest nodes; a graph that needs more than ``rounds`` raises instead of stopping early.
    """
    edges = keep(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        # stars: a node has one smaller neighbour, which itself has none
        tied = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        if edges.isEmpty() or tied.where("n > 1").unionByName(tied.join(tied.select(F.col("u").alias("v")), "v", "left_semi"), allowMissingColumns=True).isEmpty():
            hubs = edges.select(F.col("v").alias("member"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("member"), F.col("v").alias("component")).union(hubs)
        edges = keep(_small(_large(edges)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
