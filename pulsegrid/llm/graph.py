"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _star(edges: DataFrame, both: DataFrame, upward: bool) -> DataFrame:
    """Every neighbour (the greater ones only, or the smaller ones only) hung below the least of a node and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = both.where("v > u" if upward else "v < u").join(least, "u")
    hung = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not upward:
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (``u``, ``v``, longs) to one row per node with another: ``node``, ``component`` (its least node).

    Each round is written to the shared folder.  Hot nodes are aggregated before
    the shuffle and joined by sort-merge joins that adaptive execution can split.
    """
    state = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(state, both, upward=True), "large")
        # After a large star edges may lead either way; the small star looks from the greater end.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = written(_star(down, down, upward=False), "small")
        # Fixed: every node has one edge, to a node that has none upwards.
        roots = small.select(F.col("v").alias("u")).distinct()
        loose = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or small.join(roots, "u", "left_semi").limit(1).count()
        for old in (state, large):
            dropped(old.sparkSession, old)
        state = small
        if not loose:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
