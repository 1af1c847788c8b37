"""Pairs of tags found together on one item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonarrays import explode_labels
from ..model import MIN_SUPPORT, TOP_PAIRS

# Tags of a basket that stand in one row.
CHUNK = 256
#: Buckets of the first pass over pairs: at most this many numbers per task, 8 MB to each task at worst.
BUCKETS = 1 << 20


def item_tags(articles: DataFrame, item: str = "id", tags: str = "tags") -> DataFrame:
    """``id, tag`` rows of articles holding a tag array."""
    return explode_labels(articles, tags, "tag", item).withColumnRenamed(item, "id")


def tag_cooccurrence(
    rows: DataFrame, min_support: int = MIN_SUPPORT, top: int | None = TOP_PAIRS, buckets: int | None = None
) -> DataFrame:
    """``tag_a, tag_b, support`` (items holding both) from ``id, tag`` rows, duplicates allowed.

    Pairs below ``min_support`` are left out and the ``top`` best kept, ties by tag. A tag on fewer
    than ``min_support`` rows cannot be in a kept pair and is left out first; pairs are counted
    map-side before they are shuffled.

    Where there are so many different pairs that counting them map-side gains nothing, give
    ``buckets`` (such as ``BUCKETS``): a first pass counts hashes of pairs in that many buckets, and only
    pairs of buckets that reach the support are counted, and shuffled, one by one. The rows are the same.
    """
    rows = rows.where(F.col("tag").isNotNull())
    frequent = rows.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    pairs = _pairs(_baskets(rows.join(frequent.select("tag"), "tag", "left_semi")))
    if buckets:
        pairs = _in_full_buckets(pairs, min_support, buckets)
    counted = pairs.groupBy("tag_a", "tag_b").agg(F.count("*").alias("support"))
    kept = counted.where(F.col("support") >= min_support)
    if top is None:
        return kept
    return kept.orderBy(F.desc("support"), "tag_a", "tag_b").limit(top)


def _baskets(rows: DataFrame) -> DataFrame:
    """Distinct tags per item; the set is built map-side first, so a hot item stays within its vocabulary."""
    sets = rows.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return sets.where(F.size("tags") >= 2).select("tags")


def _in_full_buckets(pairs: DataFrame, min_support: int, buckets: int) -> DataFrame:
    """Pairs whose bucket holds ``min_support`` pairs or more: no other pair can reach it. Each task counts into at
    most ``buckets`` rows, and as many numbers at most go back to the tasks."""
    hashed = pairs.withColumn("_bucket", F.pmod(F.xxhash64("tag_a", "tag_b"), F.lit(buckets)))
    full = hashed.groupBy("_bucket").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("_bucket")
    return hashed.join(F.broadcast(full), "_bucket", "left_semi").select("tag_a", "tag_b")


def _pairs(baskets: DataFrame) -> DataFrame:
    """Every basket is cut into runs of ``CHUNK`` tags, and each two runs are a row of their own.

    So a row holds two runs at most, however large the basket, and rebalancing spreads a large
    basket's rows over the tasks. A basket of up to ``CHUNK`` tags is one row.
    """
    starts = F.sequence(F.lit(1), F.size("tags"), F.lit(CHUNK))
    cut = baskets.select(F.transform(starts, lambda s: F.slice("tags", s, CHUNK)).alias("runs"))
    lead = cut.select("runs", F.posexplode("runs").alias("i", "run_a"))
    met = lead.select("run_a", F.explode(F.slice("runs", F.col("i") + 1, F.size("runs"))).alias("run_b"))
    each = met.hint("rebalance").select(F.explode("run_a").alias("tag_a"), "run_b")
    return each.select("tag_a", F.explode("run_b").alias("tag_b")).where(F.col("tag_a") < F.col("tag_b"))
