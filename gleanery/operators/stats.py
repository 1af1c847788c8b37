"""Counts and profiles over articles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonarrays import as_array, explode_labels
from ..functions.labels import canonical_only, out_of_reference
from ..model import LABELS


def theme_counts(articles: DataFrame, column: str = "themes_mistral") -> DataFrame:
    """``theme, nb``, most frequent first. A label repeated in one row counts each time."""
    return (
        explode_labels(articles, column, "theme")
        .groupBy("theme")
        .agg(F.count("*").alias("nb"))
        .orderBy(F.desc("nb"), "theme")
    )


def source_counts(articles: DataFrame) -> DataFrame:
    """``source, nb``, most frequent first."""
    return articles.groupBy("source").agg(F.count("*").alias("nb")).orderBy(F.desc("nb"), "source")


def theme_frequency(
    articles: DataFrame, annotators: Mapping[str, str], labels: Sequence[str] = LABELS
) -> DataFrame:
    """``theme, source_annotation, nb, hors_referentiel`` for several label columns in one scan."""
    stacked = [x for name, column in annotators.items() for x in (F.lit(name), F.col(column))]
    each = articles.select(F.stack(F.lit(len(annotators)), *stacked).alias("source_annotation", "themes"))
    return (
        explode_labels(each, "themes", "theme", "source_annotation")
        .groupBy("theme", "source_annotation")
        .agg(F.count("*").alias("nb"))
        .withColumn("hors_referentiel", out_of_reference(F.col("theme"), labels))
        .orderBy(F.desc("nb"), "theme", "source_annotation")
    )


def label_frame(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The label set as rows ``rang, theme``."""
    rows = [(i, label) for i, label in enumerate(labels)]
    return df.sparkSession.createDataFrame(rows, "rang int, theme string")


def label_distribution(rows: DataFrame, column: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """``rang, theme, nb`` for every label of the set, zeros kept, in reporting order."""
    counts = (
        explode_labels(rows, column, "theme")
        .where(F.col("theme").isin(list(labels)))
        .groupBy("theme")
        .agg(F.count("*").alias("nb"))
    )
    return (
        label_frame(rows, labels)
        .join(counts, "theme", "left")
        .select("rang", "theme", F.coalesce("nb", F.lit(0).cast("long")).alias("nb"))
        .orderBy("rang")
    )


def sample_coverage(sample: DataFrame, labels: Sequence[str] = LABELS) -> tuple[DataFrame, DataFrame]:
    """Rows per label (zeros kept) and rows per source of a sample."""
    canonical = sample.withColumn("themes", canonical_only(as_array(sample, "themes_mistral"), labels))
    return label_distribution(canonical, "themes", labels), source_counts(sample)


def corpus_profile(articles: DataFrame) -> DataFrame:
    """``articles, avec_tags, tags_distincts, premiere_date, derniere_date, sans_date`` in one row.

    One scan: every article gives at least one row and exactly one head row (its first tag, or the
    empty row of an article without tags), so row measures are taken on heads while the grouping
    by tag, folded map-side, gives the distinct count.
    """
    has_tags = F.coalesce(F.col("tags") != F.lit("[]"), F.lit(False))
    rows = articles.select(
        "date_article", has_tags.alias("avec"), F.posexplode_outer(as_array(articles, "tags")).alias("pos", "tag")
    )
    head = F.coalesce("pos", F.lit(0)) == 0
    per_tag = rows.groupBy("tag").agg(
        F.count_if(head).alias("n"),
        F.count_if(head & F.col("avec")).alias("avec"),
        F.min("date_article").alias("premiere"),
        F.max("date_article").alias("derniere"),
        F.count_if(head & F.col("date_article").isNull()).alias("sans"),
    )
    return per_tag.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("articles"),
        F.coalesce(F.sum("avec"), F.lit(0)).alias("avec_tags"),
        F.count("tag").alias("tags_distincts"),
        F.min("premiere").alias("premiere_date"),
        F.max("derniere").alias("derniere_date"),
        F.coalesce(F.sum("sans"), F.lit(0)).alias("sans_date"),
    )


def batch_bounds(articles: DataFrame) -> DataFrame:
    """``nb_articles, premiere_date, derniere_date``."""
    return articles.agg(
        F.count("*").alias("nb_articles"),
        F.min("date_article").alias("premiere_date"),
        F.max("date_article").alias("derniere_date"),
    )


def frequent_tags(articles: DataFrame, themes: Mapping[str, str], min_count: int = 3) -> DataFrame:
    """``theme, tags, occurrences`` of the tags seen at least ``min_count`` times, per mapped theme.

    Tags outside the mapping are grouped under NULL.
    """
    counts = (
        explode_labels(articles, "tags", "tag")
        .groupBy("tag")
        .agg(F.count("*").alias("nb"))
        .where(F.col("nb") >= min_count)
    )
    entries = [F.lit(x) for pair in themes.items() for x in pair]
    theme = F.try_element_at(F.create_map(*entries), F.col("tag")) if entries else F.lit(None).cast("string")
    return (
        counts.groupBy(theme.alias("theme"))
        .agg(F.count("*").alias("tags"), F.sum("nb").alias("occurrences"))
        .orderBy(F.desc("occurrences"), "theme")
    )
