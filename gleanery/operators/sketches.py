"""Distinct counts over any range of days, from mergeable sketches kept per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_of

#: 2 ** PRECISION registers: a standard error of 0.4 %, at most 64 KB a day and column.
PRECISION = 16


def daily_sketches(articles: DataFrame, columns: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """``date`` and a sketch of each column's distinct values, for every publication day.

    Sketches of lots that arrive one after the other are merged by :func:`merged`, so a late row needs
    its own lot only. Rows without a day are left out, as are NULL values; a day without values has an empty sketch.
    """
    day = F.col("jour") if "jour" in articles.columns else day_of(F.col("date_article"))
    dated = articles.withColumn("date", day).where(F.col("date").isNotNull())
    return dated.groupBy("date").agg(*[F.hll_sketch_agg(F.col(c).cast("string"), precision).alias(c) for c in columns])


def merged(sketches: DataFrame) -> DataFrame:
    """One sketch per day and column from those of several lots."""
    columns = [c for c in sketches.columns if c != "date"]
    return sketches.groupBy("date").agg(*[F.hll_union_agg(c).alias(c) for c in columns])


def distinct_between(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """``debut, fin`` of every range (both days included) and the estimated distinct values of each column, 0 where no
    day of the range has any. Costs a sketch per day of the range, however many rows the days have."""
    columns = [c for c in sketches.columns if c != "date"]
    found = by_day(ranges, "date").join(sketches, "date", "left").groupBy("debut", "fin")
    estimates = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns]
    return found.agg(*estimates)


def exactly_between(articles: DataFrame, column: str, ranges: DataFrame, name: str) -> DataFrame:
    """``debut, fin`` of every range (both days included) and ``name``, the exact distinct values of ``column``, which
    are those of ``articles`` by ``jour``.

    A range counts a value on the first of its days there, which is the one whose day before, if any, lies ahead of
    the range. So values are told apart once, however many ranges hold them; ranges meet the counts by pair of days.
    """
    ranges = ranges.select("debut", "fin").distinct()
    days = articles.where(F.col(column).isNotNull() & F.col("jour").isNotNull()).select("jour", column).distinct()
    before = F.lag("jour").over(Window.partitionBy(F.xxhash64(column), column).orderBy("jour"))
    steps = days.select("jour", before.alias("avant")).groupBy("jour", "avant").agg(F.count("*").alias("n"))
    first = F.col("avant").isNull() | (F.col("avant") < F.least("debut", "fin"))
    found = by_day(ranges, "jour").join(steps, "jour", "left").groupBy("debut", "fin")
    return found.agg(F.coalesce(F.sum(F.when(first, F.col("n"))), F.lit(0)).alias(name))


def by_day(ranges: DataFrame, name: str) -> DataFrame:
    """A row per day of every range ``debut, fin``."""
    return ranges.select("debut", "fin", F.explode(F.sequence("debut", "fin")).alias(name))
