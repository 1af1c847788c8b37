"""Insert-if-new of incoming articles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir
from .normalize import from_events, from_legacy, reject_reason


def rejected(events: DataFrame) -> DataFrame:
    """Events that cannot be stored, with ``motif``; lines that are no JSON keep their text in ``ligne``."""
    reason = reject_reason()
    if "_corrupt_record" in events.columns:
        events = events.withColumnRenamed("_corrupt_record", "ligne")
        reason = F.when(F.col("ligne").isNotNull(), F.lit("unreadable JSON")).otherwise(reason)
    return events.withColumn("motif", reason).where(F.col("motif").isNotNull())


def first_per_url(rows: DataFrame, order: str) -> DataFrame:
    """The earliest row of each URL.

    The rank filter also runs before the shuffle, so a URL sent again and again costs each task
    one row. URLs begin alike, so rows are sorted by their hash before the text is compared.
    """
    rank = F.row_number().over(Window.partitionBy(F.xxhash64("url"), "url").orderBy(order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def absent_from(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose URL is not stored yet.

    A plain anti join would shuffle every stored URL. The stored side is first narrowed by a semi
    join with the distinct incoming URLs, the small side: Catalyst broadcasts them below its size
    threshold and shuffles otherwise.
    """
    incoming = rows.select("url").distinct()
    known = existing.select("url").join(incoming, "url", "left_semi").distinct()
    return rows.join(known, "url", "left_anti")


def numbered_after(highest: int, rows: DataFrame, place: str) -> DataFrame:
    """Stored ``rows`` with ``id`` numbers above ``highest``, without gaps.

    ``place`` holds the monotonically increasing ids they were stored with: task by task, counting
    from a new start in each. What is put in order in one place are the tasks' counts.
    """
    part = F.shiftright(place, 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    joined = rows.withColumn("_part", part).join(before, "_part")
    columns = [c for c in rows.columns if c != place]
    return joined.select((F.lit(highest) + 1 + F.col("_before") + within).alias("id"), *columns)


def new_articles(existing: DataFrame, candidates: DataFrame, order: str) -> DataFrame:
    """Candidate rows to append, first of each URL, numbered after the highest stored id without gaps.

    The rows are stored before they are numbered, so that numbers cannot differ between two evaluations.
    """
    spark = candidates.sparkSession
    fresh = absent_from(first_per_url(candidates, order), existing).drop(order)
    placed = fresh.withColumn("_place", F.monotonically_increasing_id())
    path = work_dir(spark, "new-articles")
    placed.write.parquet(path)
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered_after(highest, spark.read.schema(placed.schema).parquet(path), "_place")


def ingest_batch(
    existing: DataFrame, incoming: DataFrame, now: str | dt.datetime, order: str
) -> tuple[DataFrame, DataFrame]:
    """``(rows to append, rejects)`` of a batch of events; ``order`` ranks their arrival."""
    candidates = from_events(incoming.where(reject_reason().isNull()), now, order)
    return new_articles(existing, candidates, order), rejected(incoming)


def legacy_batch(existing: DataFrame, records: DataFrame, now: str | dt.datetime, order: str) -> DataFrame:
    """Rows to append from the former file format."""
    return new_articles(existing, from_legacy(records, now, order), order)
