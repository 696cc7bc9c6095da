"""Connected components over a table of links, with every round a few joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import kept, release


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each u with the least of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Each node of links with the smallest node that is reachable from it: columns (id, component).

    Alternates large-star and small-star steps, which need about log(n) rounds even on chains. No step gathers the
    neighbours of a node: hubs are met by partial minima and by joins that adaptive execution may split. Links with a
    null end and links of a node with itself are passed over; repeated links count once; no links, no rows.
    """
    edges = kept(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            .unionByName(edges.join(_least(both), "u").select("u", F.col("m").alias("v")).where("u != v"))
            .distinct()
        )
        large = kept(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = kept(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        del both, large, least, small
        release(links.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # at rest every edge runs from a node to its component's least node
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
