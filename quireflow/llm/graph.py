"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b) -> (node, component): the smallest node reachable, for each node with an edge.

    Alternates two rewirings until only stars are left: each node hangs its larger
    neighbours under the smallest node it sees, then its smaller ones. The
    rounds grow with the logarithm of the longest path. A star's centre is
    only met in partial aggregates and in joins with written tables, which
    adaptive execution can split, never as one group. Self-loops and null ends are ignored.
    """
    flat = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = scratch.keep(flat.distinct())
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        root = large.groupBy("u").agg(F.min("v").alias("m"))  # few edges go up from one node, so this side needs no splitting
        small = large.join(root, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        after = scratch.keep(small)
        scratch.drop(now, large, least)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one other at most, and none under one that hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()
