"""Calendar dimension and daily aggregate of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_of, day_of_week, week_of_year
from ..functions.jsonarrays import as_array


def _with_day(articles: DataFrame) -> DataFrame:
    """Adds ``date``, the UTC publication day: the stored ``jour`` partition where there is one."""
    day = F.col("jour") if "jour" in articles.columns else day_of(F.col("date_article"))
    return articles.withColumn("date", day).where(F.col("date").isNotNull())


def calendar(articles: DataFrame) -> DataFrame:
    """``date_complete, annee, mois, semaine, jour_semaine`` of every publication day."""
    return calendar_of(_with_day(articles).select("date").distinct())


def calendar_of(days: DataFrame) -> DataFrame:
    """The calendar rows of distinct ``date`` values."""
    return days.select(
        F.col("date").alias("date_complete"),
        F.year("date").alias("annee"),
        F.month("date").alias("mois"),
        week_of_year(F.col("date")).alias("semaine"),
        day_of_week(F.col("date")).alias("jour_semaine"),
    )


def daily_aggregate(articles: DataFrame) -> DataFrame:
    """``date, est_total, thematique, nb_articles, score_moyen`` per day and theme, plus day totals."""
    return averaged(daily_partials(articles))


def averaged(partials: DataFrame) -> DataFrame:
    """The aggregate of partials that have one row per day and theme."""
    return partials.select(
        "date", "est_total", "thematique", F.col("n").alias("nb_articles"), F.try_divide("s", "k").alias("score_moyen")
    )


def summed(partials: DataFrame) -> DataFrame:
    """Partials of several lots of articles as those of all: sums and counts add up, whatever came when."""
    sums = [F.sum(c).alias(c) for c in ("n", "s", "k")]
    return partials.groupBy("date", "est_total", "thematique").agg(*sums)


def daily_partials(articles: DataFrame) -> DataFrame:
    """``date, est_total, thematique, n, s, k``: articles, sum of scores and articles with a score.

    The total must not come from summed theme rows: they count a multi-theme article several times
    and miss one without themes. Every article gives at least one row and exactly one head row (its
    first theme, or the empty row of an article without themes); the total is taken on heads. So
    one scan serves both kinds of rows; the split happens on the grouped result, which is small
    when it is shuffled once more for the totals.
    """
    rows = _with_day(articles).select(
        "date", "score_mistral", F.posexplode_outer(as_array(articles, "themes_mistral")).alias("pos", "thematique")
    )
    head = F.coalesce("pos", F.lit(0)) == 0
    score_of_head = F.when(head, F.col("score_mistral"))
    cells = rows.groupBy("date", "thematique").agg(
        F.count("*").alias("n"),
        F.sum("score_mistral").alias("s"),
        F.count("score_mistral").alias("k"),
        F.count_if(head).alias("n_head"),
        F.sum(score_of_head).alias("s_head"),
        F.count(score_of_head).alias("k_head"),
    )
    theme = F.struct(F.lit(False).alias("est_total"), F.col("thematique"), "n", "s", "k")
    total = F.struct(
        F.lit(True).alias("est_total"),
        F.lit(None).cast("string").alias("thematique"),
        F.col("n_head").alias("n"),
        F.col("s_head").alias("s"),
        F.col("k_head").alias("k"),
    )
    both = F.when(F.col("thematique").isNull(), F.array(total)).otherwise(F.array(theme, total))
    return summed(cells.select("date", F.inline(both)))


def timeline(aggregate: DataFrame) -> DataFrame:
    """``jour, nb`` from the totals of the aggregate, oldest first."""
    return (
        aggregate.where("est_total").select(F.col("date").alias("jour"), F.col("nb_articles").alias("nb")).orderBy("jour")
    )


def theme_counts_from_aggregate(aggregate: DataFrame) -> DataFrame:
    """``theme, nb`` without touching the facts; undated articles are not in it."""
    return (
        aggregate.where(~F.col("est_total"))
        .groupBy(F.col("thematique").alias("theme"))
        .agg(F.sum("nb_articles").alias("nb"))
        .orderBy(F.desc("nb"), "theme")
    )


def theme_trend(aggregate: DataFrame) -> DataFrame:
    """``mois, theme, nb`` per month from the aggregate."""
    return (
        aggregate.where(~F.col("est_total"))
        .groupBy(F.date_format("date", "yyyy-MM").alias("mois"), F.col("thematique").alias("theme"))
        .agg(F.sum("nb_articles").alias("nb"))
        .orderBy("mois", "theme")
    )


def crosscheck(aggregate: DataFrame, articles: DataFrame) -> DataFrame:
    """``date, nb_agregat, nb_calcule`` of the days where aggregate and facts differ; empty when sound."""
    stored = aggregate.where("est_total").select("date", F.col("nb_articles").alias("nb_agregat"))
    counted = _with_day(articles).groupBy("date").agg(F.count("*").alias("nb_calcule"))
    return stored.join(counted, "date", "full").where(~F.col("nb_agregat").eqNullSafe(F.col("nb_calcule")))


def gaps(days: DataFrame, key: str, day: str) -> DataFrame:
    """``key, ecart_j`` between successive distinct days of each key.

    Days are made distinct first, so the ordered window sees a calendar's worth of rows per key.
    """
    distinct = days.where(F.col(day).isNotNull()).select(key, day).distinct()
    previous = F.lag(day).over(Window.partitionBy(key).orderBy(day))
    return distinct.select(key, F.datediff(F.col(day), previous).alias("ecart_j")).where(F.col("ecart_j").isNotNull())


def collection_regularity(days: DataFrame, day: str) -> DataFrame:
    """``jours_couverts, etendue_j, pct_couvert``: share of the days in the span that have rows."""
    one = days.where(F.col(day).isNotNull()).agg(
        F.countDistinct(day).alias("jours_couverts"),
        (F.datediff(F.max(day), F.min(day)) + 1).alias("etendue_j"),
    )
    return one.withColumn("pct_couvert", F.round(100.0 * F.col("jours_couverts") / F.col("etendue_j"), 1))
