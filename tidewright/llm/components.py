"""Connected components by alternating large-star and small-star steps over an edge table.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is two grouped
minima and is written to the shared folder, so lineage stays short; rounds grow with the logarithm of
the longest chain. Hubs are safe: a node's edges are only reduced to a minimum, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours to the least of the neighbourhood: larger ones (large) or smaller ones and itself."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("low").alias("b"))
        )
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Self-loops, repeated edges and either direction are fine; no edges gives no rows.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "components")
    mark = None
    while True:
        stats = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stats == mark or stats[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = stats
        now = materialize(_star(_star(now, True), False), "components")
