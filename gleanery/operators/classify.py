"""Second classification: from model responses to stored labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import kept_labels, round_half_up, top_score, usable_scores
from ..functions.text import model_input
from ..model import LABEL_HYPOTHESES, SCORE_THRESHOLD


def model_inputs(queue: DataFrame) -> DataFrame:
    """The queue with ``texte``, the input of the model."""
    return queue.withColumn("texte", model_input(F.col("titre"), F.col("resume")))


def labels_from_scores(
    scored: DataFrame,
    pairs: Column,
    hypotheses: Mapping[str, str] = LABEL_HYPOTHESES,
    threshold: float = SCORE_THRESHOLD,
    places: int | None = None,
) -> DataFrame:
    """Adds ``themes`` (labels at or above the threshold), ``confiance`` (best score) and ``erreur``.

    ``confiance`` is the best score even below the threshold, rounded half up when ``places`` is
    given. A response with no usable pair leaves both NULL and says so in ``erreur``.
    """
    usable = scored.withColumn("_usable", usable_scores(pairs, hypotheses))
    best = top_score(F.col("_usable"))
    empty = F.coalesce(F.size("_usable"), F.lit(0)) <= 0
    return usable.withColumns(
        {
            "themes": kept_labels(F.col("_usable"), threshold),
            "confiance": best if places is None else round_half_up(best, places),
            "erreur": F.when(empty, F.lit("unusable response")),
        }
    ).drop("_usable")


def label_updates(labelled: DataFrame, key: str = "url", *keep: str) -> DataFrame:
    """``key, themes_ml, score_confiance_ml`` for :func:`updates.keyed_update`; failures stay queued.

    Failures are left out by generating no row: a filter would be pushed below the labels and read every response again.
    """
    labels = F.struct(F.to_json("themes").alias("themes_ml"), F.col("confiance").alias("score_confiance_ml"))
    return labelled.select(key, *keep, F.inline(F.when(F.col("erreur").isNull(), F.array(labels))))


def outcome_counts(labelled: DataFrame) -> DataFrame:
    """``classes, echecs, sans_theme`` of a run; a row without label is also classified."""
    return labelled.agg(
        F.count_if(F.col("erreur").isNull()).alias("classes"),
        F.count_if(F.col("erreur").isNotNull()).alias("echecs"),
        F.count_if(F.col("erreur").isNull() & (F.size("themes") == 0)).alias("sans_theme"),
    )
