"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hangs the neighbours of every node on the smallest of them and the node itself.

    ``pairs`` holds (u, v), u <> v. The minimum is folded before the shuffle and joined back, so that a node
    with very many neighbours is a skewed join, which adaptive execution splits, and never one group.
    """
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = pairs.join(lowest, pairs["u"] == lowest["w"])
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    if larger:
        return hung
    own = lowest.select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.unionByName(own)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that has an edge to another.

    ``edges`` has two columns of one orderable type, in any direction, repeats and self-links allowed. NULL ends
    are dropped. No edges give no rows.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    now = materialize(now.distinct(), spark, "edges")
    seen = _print(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger=True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = materialize(_star(large.distinct(), larger=False).distinct(), spark, "edges")
        found = _print(now)
        if found == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = found


def _print(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges; two rounds with the same one have converged."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mixed), F.sum(mixed % 1_000_003)).first())
