"""Keyed updates of stored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_key(updates: DataFrame, key: str, cols: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``: what a sequence of updates leaves behind."""
    last = F.max_by(F.struct(*cols), F.col(order)).alias("last")
    return updates.groupBy(key).agg(last).select(key, *[F.col("last")[c].alias(c) for c in cols])


def keyed_update(
    articles: DataFrame, updates: DataFrame, key: str, cols: Sequence[str], order: str | None = None
) -> DataFrame:
    """``articles`` with ``cols`` replaced where ``updates`` has their key, other rows unchanged.

    Of several updates for a key the last by ``order`` holds. Without ``order`` keys should not
    repeat; if they do, the greatest values hold, so that no row is ever doubled.
    """
    ranked = updates.withColumn("_order", F.col(order) if order else F.struct(*cols))
    return overlaid(articles, last_per_key(ranked, key, cols, "_order"), key, cols)


def overlaid(articles: DataFrame, given: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``articles`` with ``cols`` from ``given``, which has one row per key, where it has theirs."""
    # A hint on ``given`` must stay at the join, so the columns are renamed below it.
    renamed = given.withColumnsRenamed({c: f"_new_{c}" for c in cols}).withColumn("_hit", F.lit(True))
    joined = articles.join(renamed, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in articles.columns
        ]
    )
