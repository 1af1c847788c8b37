"""Freshness and classification health of the collection."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_between, iso_text, moment, parse_iso
from ..model import FRESH_ALERT_DAYS, FRESH_OK_DAYS, LATE_HOURS

# Statuses from best to worst.
STATUSES = ["ok", "degrade", "alerte"]


def late_threshold(now: str | dt.datetime, hours: int = LATE_HOURS) -> Column:
    """Canonical text of the instant before which an unclassified article is late."""
    return iso_text(moment(now) - F.make_dt_interval(hours=F.lit(hours)))


def health_counters(articles: DataFrame, now: str | dt.datetime, late_hours: int = LATE_HOURS) -> DataFrame:
    """The five raw counters in one scan; they look at stored text, not at parsed arrays."""
    late = F.col("themes_ml").isNull() & (F.col("date_collecte") < late_threshold(now, late_hours))
    return articles.agg(
        F.max("date_collecte").alias("dernier_article_collecte"),
        F.count("*").alias("total"),
        F.count_if(late).alias("ml_en_retard"),
        F.count_if(F.col("themes_ml") == "[]").alias("ml_sans_theme"),
        F.count_if(F.col("themes_mistral").isNull()).alias("mistral_manquants"),
    )


def freshness_status(days: Column, ok_days: int = FRESH_OK_DAYS, alert_days: int = FRESH_ALERT_DAYS) -> Column:
    return F.when(days <= ok_days, "ok").when(days <= alert_days, "degrade").otherwise("alerte")


def worst(*statuses: Column) -> Column:
    order = F.array(*[F.lit(s) for s in STATUSES])
    rank = F.greatest(*[F.array_position(order, s) for s in statuses])
    return F.element_at(order, rank.cast("int"))


def judge(
    counters: DataFrame,
    now: str | dt.datetime,
    ok_days: int = FRESH_OK_DAYS,
    alert_days: int = FRESH_ALERT_DAYS,
) -> DataFrame:
    """Nested verdict ``statut, collecte, classification`` from the counters.

    No readable last date is an alert; a date slightly ahead of the clock counts as zero days.
    """
    age = days_between(moment(now), parse_iso(F.col("dernier_article_collecte")))
    # greatest() skips NULL, which would turn "never collected" into zero days.
    days = F.when(age.isNotNull(), F.greatest(F.lit(0), F.floor(age)).cast("int"))
    judged = counters.withColumn("jours_depuis", days).withColumns(
        {
            "statut_collecte": freshness_status(F.col("jours_depuis"), ok_days, alert_days),
            "statut_classification": F.when(F.col("ml_en_retard") > 0, "alerte").otherwise("ok"),
        }
    )
    return judged.select(
        worst(F.col("statut_collecte"), F.col("statut_classification")).alias("statut"),
        F.struct(
            "dernier_article_collecte", "jours_depuis", F.col("statut_collecte").alias("statut")
        ).alias("collecte"),
        F.struct(
            "total",
            "ml_en_retard",
            "ml_sans_theme",
            "mistral_manquants",
            F.col("statut_classification").alias("statut"),
        ).alias("classification"),
    )


def health_report(
    articles: DataFrame,
    now: str | dt.datetime,
    ok_days: int = FRESH_OK_DAYS,
    alert_days: int = FRESH_ALERT_DAYS,
    late_hours: int = LATE_HOURS,
) -> DataFrame:
    return judge(health_counters(articles, now, late_hours), now, ok_days, alert_days)


def health_by_dates(articles: DataFrame, now: str | dt.datetime) -> DataFrame:
    """The operations variant: date arithmetic and fractional-day limits instead of text order.

    Agrees with :func:`health_report` when every collection date is canonical; used as its check.
    """
    age = days_between(moment(now), parse_iso(F.col("date_collecte")))
    counters = articles.agg(
        F.max("date_collecte").alias("dernier_article_collecte"),
        F.count("*").alias("total"),
        F.count_if(F.col("themes_ml").isNull() & (age > LATE_HOURS / 24)).alias("ml_en_retard"),
        F.count_if(F.col("themes_ml") == "[]").alias("ml_sans_theme"),
        F.count_if(F.col("themes_mistral").isNull()).alias("mistral_manquants"),
    )
    last = days_between(moment(now), parse_iso(F.col("dernier_article_collecte")))
    return counters.select(
        "*",
        last.cast("int").alias("jours_depuis"),
        F.when(last < FRESH_OK_DAYS + 1, "ok")
        .when(last < FRESH_ALERT_DAYS + 1, "degrade")
        .otherwise("alerte")
        .alias("statut_collecte"),
        F.when(F.col("ml_en_retard") > 0, "alerte").otherwise("ok").alias("statut_classification"),
    )


def freshness_backtest(
    days: DataFrame, day: str, ok_days: int = FRESH_OK_DAYS, alert_days: int = FRESH_ALERT_DAYS
) -> DataFrame:
    """``statut, jours``: what freshness would have said on each day between first and last row."""
    present = days.where(F.col(day).isNotNull()).select(F.col(day).alias("d")).distinct()
    following = F.lead("d").over(Window.orderBy("d"))
    # Each day present answers for itself and the empty days up to the next one.
    runs = present.select("d", F.coalesce(F.date_sub(following, 1), F.col("d")).alias("until"))
    each = runs.select("d", F.explode(F.sequence("d", "until")).alias("jour"))
    status = freshness_status(F.datediff("jour", "d"), ok_days, alert_days)
    return each.groupBy(status.alias("statut")).agg(F.count("*").alias("jours"))
