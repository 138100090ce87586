"""Connected components of an edge table by alternating large and small stars.

Every round replaces edges by stars towards the smallest neighbour, first over larger neighbours and then over
smaller ones, until no node is both an end and a centre; the edges are then (node, smallest node reachable). Rounds grow with the
logarithm of a component's size, and no node's neighbours are ever gathered: minima are partial aggregates, and
the joins that spread them read written tables on both sides, so that a hub's rows can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgraph.plans.store import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component): for each node with an edge to another one, the smallest node that it reaches.

    Null ends, loops and repeated edges count for nothing. Nodes without edges don't appear.
    """
    now = materialize(
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "cc-edges",
    )
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = materialize(
            both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large"
        )
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        discard(now, lowest, large, lower)
        now = after
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether each node points to one centre and no centre points on."""
    centres = edges.select(F.col("v").alias("u")).distinct()
    ends = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return ends.join(centres.withColumn("centre", F.lit(True)), "u", "left").where("n > 1 OR centre").isEmpty()
