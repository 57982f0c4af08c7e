"""Connected components by alternating large-star and small-star.

Both steps are joins and minima over an edge table: a node's neighbours are
never gathered, so a node with millions of them is no hot group (the minimum
is pre-aggregated, and the join against one row per node can be split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour v of u is linked to the smallest node around u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """u and each smaller neighbour v of u are linked to the smallest of them (edges point down)."""
    least = _minimum(edges)
    joined = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v long): the smallest node reachable.

    Self loops, repeated edges and both directions are allowed; an empty edge table gives no rows.
    """
    edges = stage.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "edges0")
    turn, before = 0, None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before, turn = now, turn + 1
        edges = stage.table(small_star(large_star(edges)), f"edges{turn}")
        stage.drop(f"edges{turn - 1}")
    down = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return down.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
