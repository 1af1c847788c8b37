"""Weekly volumes and their trailing mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, over_last_rows


def weekly_trend(dated: DataFrame, moment: str, key: str | None = None, rows: int = 4) -> DataFrame:
    """``semaine, nb_articles, moyenne_glissante_4s`` (per ``key`` when given).

    Weeks are 7-day windows from the epoch, so they start on Thursdays; weeks without rows are
    absent and the mean covers the last ``rows`` weeks present. The ordered window runs on weekly
    totals only, a size set by the calendar and not by the data.
    """
    keys = [key] if key else []
    weekly = (
        dated.where(F.col(moment).isNotNull())
        .groupBy(*keys, F.window(moment, "7 days").alias("w"))
        .agg(F.count("*").alias("nb_articles"))
        .select(*keys, F.to_date("w.start").alias("semaine"), "nb_articles")
    )
    return with_trailing_mean(weekly, key, rows)


def with_trailing_mean(weekly: DataFrame, key: str | None = None, rows: int = 4) -> DataFrame:
    """``semaine, nb_articles`` rows with the mean of the last ``rows`` of them, in order."""
    keys = [key] if key else []
    order = Window.partitionBy(*keys).orderBy("semaine") if keys else Window.orderBy("semaine")
    trailing = F.avg("nb_articles").over(order.rowsBetween(1 - rows, 0))
    return weekly.withColumn("moyenne_glissante_4s", F.round(trailing, 2)).orderBy(*keys, "semaine")


def fine_trend(dated: DataFrame, moment: str, width: str = "1 second", rows: int = 4, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``debut, nb_articles, moyenne_glissante`` per bucket of ``width``: the trend where buckets are as many as rows.

    As in :func:`weekly_trend` empty buckets are absent and the mean covers the last ``rows`` present;
    the ordered window runs over ranges of buckets instead of all of them in one place.
    """
    counted = dated.where(F.col(moment).isNotNull()).groupBy(F.window(moment, width).alias("w")).agg(F.count("*").alias("nb_articles"))
    buckets = counted.select(F.col("w.start").alias("debut"), "nb_articles")
    found = over_last_rows(buckets, "debut", rows, F.avg("nb_articles"), "moyenne_glissante", range_rows)
    return found.withColumn("moyenne_glissante", F.round("moyenne_glissante", 2))
