"""Process indicators before and after a boundary date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between, parse_iso
from ..model import ERA_BOUNDARY
from .star import gaps


def gap_regularity(days: DataFrame, key: str, day: str) -> DataFrame:
    """``key, intervalle_moyen_j, intervalle_median_j, plus_longue_interruption_j``.

    A key with a single day has no gap and no row.
    """
    return (
        gaps(days, key, day)
        .groupBy(key)
        .agg(
            F.round(F.avg("ecart_j"), 1).alias("intervalle_moyen_j"),
            F.round(F.percentile("ecart_j", 0.5), 1).alias("intervalle_median_j"),
            F.max("ecart_j").alias("plus_longue_interruption_j"),
        )
    )


def _share(part: str) -> Column:
    return F.round(100.0 * F.col(part) / F.col("articles"), 1)


def process_kpis(
    articles: DataFrame, boundary: str = ERA_BOUNDARY, before: str = "avant", after: str = "apres"
) -> DataFrame:
    """One row per era: volumes, publication age, score shares, diversity and regularity."""
    collected = parse_iso(F.col("date_collecte"))
    score = F.col("score_mistral")
    facts = articles.select(
        F.when(F.col("date_collecte") < boundary, before).otherwise(after).alias("ere"),
        F.to_date(collected).alias("jour"),
        "categorie_mistral",
        "source",
        score,
        F.col("themes_mistral").isNull().cast("int").alias("sans_theme"),
        days_between(collected, parse_iso(F.col("date_article"))).alias("age"),
    )
    volumes = facts.groupBy("ere").agg(
        F.count("*").alias("articles"),
        F.countDistinct("jour").alias("passes"),
        F.min("jour").alias("premiere_collecte"),
        F.max("jour").alias("derniere_collecte"),
        F.avg("age").alias("age"),
        F.sum((score == 3).cast("int")).alias("s3"),
        F.sum((score == 4).cast("int")).alias("s4"),
        F.sum(score.isin(1, 2).cast("int")).alias("notes_1_ou_2"),
        F.sum((score == 5).cast("int")).alias("notes_5"),
        F.countDistinct("categorie_mistral").alias("categories_distinctes"),
        F.sum((F.col("categorie_mistral") == "HORS_SCOPE").cast("int")).alias("hors_scope"),
        F.countDistinct("source").alias("sources_distinctes"),
        F.sum("sans_theme").alias("sans_theme"),
    )
    shown = volumes.select(
        "ere",
        "articles",
        "passes",
        "premiere_collecte",
        "derniere_collecte",
        F.datediff("derniere_collecte", "premiere_collecte").alias("etendue_j"),
        F.when(F.col("passes") > 0, F.round(1.0 * F.col("articles") / F.col("passes"), 1)).alias("articles_par_passe"),
        F.round("age", 1).alias("age_moyen_j"),
        _share("s3").alias("pct_score_3"),
        _share("s4").alias("pct_score_4"),
        "notes_1_ou_2",
        "notes_5",
        "categories_distinctes",
        "hors_scope",
        "sources_distinctes",
        "sans_theme",
    )
    regularity = gap_regularity(facts.select("ere", "jour"), "ere", "jour")
    # An inner join, as in the report: an era with one collection day is not shown.
    return shown.join(regularity, "ere").orderBy(F.desc("ere"))
