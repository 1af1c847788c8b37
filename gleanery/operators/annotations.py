"""Manual annotations: validation, canonical form and work sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import join_labels, split_labels
from ..functions.text import strip_white
from ..model import LABELS


class AnnotationsRejected(ValueError):
    """Raised by :func:`require_valid` when at least one line was rejected."""


def parse_lines(lines: DataFrame) -> DataFrame:
    """``ligne, texte, id_texte, id, themes`` of data lines, split at the first comma."""
    before = F.substring_index("texte", ",", 1)
    split = lines.select(
        "ligne",
        "texte",
        F.when(F.contains("texte", F.lit(",")), strip_white(before)).alias("id_texte"),
        split_labels(F.substr("texte", F.length(before) + 2)).alias("themes"),
    )
    # An empty id reads as zero and "12.0" as twelve, as in the number rules of the sheet's tool.
    number = F.when(F.col("id_texte") == "", "0").otherwise(F.col("id_texte")).try_cast("decimal(38, 18)")
    whole = number.try_cast("bigint")
    return split.select("ligne", "texte", "id_texte", F.when(whole == number, whole).alias("id"), "themes")


def validate_annotations(
    lines: DataFrame, articles: DataFrame, labels: Sequence[str] = LABELS
) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)`` of annotation lines; each reject carries the first reason that applies.

    Reasons, in order: no comma, id not an integer, id unknown, id seen on an earlier line, unknown
    label. The first line of an id claims it even when its labels are refused.
    """
    parsed = parse_lines(lines)
    ids = parsed.where(F.col("id").isNotNull())
    # One row per id: a hot id folds map-side here, and its lines are split by the skew join below.
    first = ids.groupBy("id").agg(F.min("ligne").alias("premiere"))
    # The stored ids are narrowed to the annotated ones before anything of them is shuffled.
    stored = articles.select("id").join(first.select("id"), "id", "left_semi").distinct()
    known = first.join(stored, "id")
    # Lines without an id stay out of the join, where they would be one key.
    unread = parsed.where(F.col("id").isNull()).withColumn("premiere", F.lit(None).cast("long"))
    joined = ids.join(known, "id", "left").unionByName(unread)
    foreign = F.filter("themes", lambda t: ~t.isin(list(labels)))
    reason = (
        F.when(F.col("id_texte").isNull(), "no comma")
        .when(F.col("id").isNull(), "id is not an integer")
        .when(F.col("premiere").isNull(), "unknown id")
        .when(F.col("ligne") > F.col("premiere"), "duplicate id")
        .when(F.size(foreign) > 0, "unknown label")
    )
    judged = joined.withColumn("motif", reason)
    valid = judged.where(F.col("motif").isNull()).select("ligne", "id", "themes")
    rejects = judged.where(F.col("motif").isNotNull()).select("ligne", "texte", "motif")
    return valid, rejects


def require_valid(rejects: DataFrame, shown: int = 20) -> None:
    """Raises when any line was rejected, quoting the first few."""
    first = rejects.orderBy("ligne").limit(shown).collect()
    if first:
        listed = "; ".join(f"L{r['ligne']}: {r['motif']}" for r in first)
        raise AnnotationsRejected(listed)


def canonical_sheet(valid: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """``id, themes_manuels`` sorted by id, labels in reporting order joined by ``|``."""
    return valid.select("id", join_labels(F.col("themes"), labels).alias("themes_manuels")).orderBy("id")


def without_label(valid: DataFrame) -> DataFrame:
    """Annotations without any label, to be warned about."""
    return valid.where(F.size("themes") == 0).select("id").orderBy("id")


def annotation_sheet(sample: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Work sheet: sample columns with the suggested labels, empty when there is none.

    ``suggestions`` has ``id, themes``. The first classifier's labels are withheld on purpose.
    """
    suggested = suggestions.select("id", F.col("themes").alias("_themes"))
    columns = [c for c in ("id", "titre", "resume", "source", "url") if c in sample.columns]
    return (
        sample.select(*columns)
        .join(suggested, "id", "left")
        .select(*columns, F.coalesce("_themes", F.array().cast("array<string>")).alias("themes"))
    )
