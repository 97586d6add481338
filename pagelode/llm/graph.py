"""Connected components of an edge table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(e: DataFrame) -> bool:
    """Whether each node above has one edge and is below none, so that edges name components."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    return ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 or (above > 0 and below > 0)").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that edges (a, b) name; component is the smallest node reachable.

    Alternating large-star and small-star steps. Each step finds every node's smallest neighbour with a
    pre-aggregated minimum and joins it back, so a hub's neighbours are never gathered in one row; skewed
    hubs are split by the adaptive join. Rounds grow with the logarithm of a component's diameter, and end when only
    stars are left, which one pre-aggregated pass over the edges tells. Edges
    with a null end and loops are ignored; an empty table gives an empty table."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = checkpointed(e)
    for _ in range(rounds):
        if _stars(e):
            break
        # Large star: every neighbour above a node moves to the node's smallest neighbour (or the node).
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's smaller neighbours, and the node, move to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
