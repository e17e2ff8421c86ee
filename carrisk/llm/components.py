"""Connected components as alternating star contraction, in DataFrame operations only.

Every round points each node's larger neighbours (large star), then its
smaller ones and itself (small star), at the least neighbour known; edges end
as stars around each component's least node in O(log n) rounds.  A node's
least neighbour is a ``min`` aggregate, summed before its shuffle, joined back
to the edges: a hub with a third of all edges is one row on the aggregate's
side, and its edges may be split over tasks by AQE's skew join.  Rounds are
written to the shared folder, so a lost executor costs one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrisk.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.min("dst").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = _least(both).select("src", F.least("src", "low").alias("low"))
    return both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have src > dst."""
    low = _least(edges)
    moved = edges.join(low, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return low.select("src", F.col("low").alias("dst")).unionByName(moved).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either points at one node, or is pointed at."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out + into > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (src, dst): component is its least node.

    Loops, repeated and reversed edges and edges with a null end are fine; no edges give no rows.
    """
    edges = edges.select("src", "dst").where("src <> dst")
    stars = written(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    while not _are_stars(stars):
        stars = written(_small_star(_large_star(stars)), "cc")
    member = stars.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return member.unionByName(stars.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
