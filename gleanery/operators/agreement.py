"""How far two annotators of the same rows agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonarrays import as_label_set
from ..functions.labels import round_half_up
from ..functions.sets import disjoint, jaccard, overlap_size, same_set
from ..model import LABELS, SCORE_THRESHOLD
from .stats import label_frame


def _both(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(as_label_set(df, a).alias("a"), as_label_set(df, b).alias("b"))


def agreement_global(df: DataFrame, a: str, b: str, empty_is_match: bool = True) -> DataFrame:
    """``total, compares, accord_exact, chevauchement, jaccard_moyen`` in one pass.

    Only rows labelled by both are compared. ``empty_is_match`` sets the Jaccard of two empty sets.
    """
    sets = _both(df, a, b)
    comparable = F.col("a").isNotNull() & F.col("b").isNotNull()
    score = F.when(comparable, jaccard(F.col("a"), F.col("b"), empty_is_match))
    return sets.agg(
        F.count("*").alias("total"),
        F.count_if(comparable).alias("compares"),
        F.count_if(comparable & same_set(F.col("a"), F.col("b"))).alias("accord_exact"),
        F.count_if(comparable & (overlap_size(F.col("a"), F.col("b")) > 0)).alias("chevauchement"),
        F.coalesce(round_half_up(F.avg(score), 3), F.lit(0.0)).alias("jaccard_moyen"),
    )


def agreement_by_label(df: DataFrame, a: str, b: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """``rang, theme, accord, mistral_seul, ml_seul`` for every label of the set, zeros kept."""
    # A missing side makes the union NULL, so rows not labelled by both drop out in the explode.
    sets = _both(df, a, b)
    in_a, in_b = F.array_contains("a", F.col("theme")), F.array_contains("b", F.col("theme"))
    counts = (
        sets.select("a", "b", F.explode(F.array_union("a", "b")).alias("theme"))
        .where(F.col("theme").isin(list(labels)))
        .groupBy("theme")
        .agg(
            F.count_if(in_a & in_b).alias("accord"),
            F.count_if(in_a & ~in_b).alias("mistral_seul"),
            F.count_if(~in_a & in_b).alias("ml_seul"),
        )
    )
    zero = F.lit(0).cast("long")
    return (
        label_frame(df, labels)
        .join(counts, "theme", "left")
        .select("rang", "theme", *[F.coalesce(c, zero).alias(c) for c in ("accord", "mistral_seul", "ml_seul")])
        .orderBy("rang")
    )


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows labelled by both without a common label; an empty set disagrees with everything."""
    return df.where(disjoint(as_label_set(df, a), as_label_set(df, b)))


def concordance(df: DataFrame, a: str, b: str) -> DataFrame:
    """``annotations, accord_exact, pct_exact, jaccard_moyen``; two empty sets are equal but score 0."""
    one = agreement_global(df, a, b, empty_is_match=False)
    share = F.floor(100.0 * F.col("accord_exact") / F.col("compares") + 0.5)
    return one.select(
        F.col("compares").alias("annotations"),
        "accord_exact",
        F.when(F.col("compares") > 0, share).alias("pct_exact"),
        F.when(F.col("compares") > 0, F.col("jaccard_moyen")).alias("jaccard_moyen"),
    )


def micro_f1(df: DataFrame, truth: str, usable: str, thresholds: Sequence[float] = (SCORE_THRESHOLD,)) -> DataFrame:
    """``seuil, vrais_positifs, faux_positifs, faux_negatifs, micro_f1`` per threshold.

    ``truth`` is a label array, ``usable`` an array of ``struct<label, score>``.
    """
    seuil = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("seuil")
    wide = df.where(F.col(truth).isNotNull() & F.col(usable).isNotNull()).select(seuil, truth, usable)
    kept = F.array_distinct(
        F.transform(F.filter(usable, lambda p: p["score"] >= F.col("seuil")), lambda p: p["label"])
    )
    hits = F.size(F.array_intersect(truth, kept))
    sums = wide.groupBy("seuil").agg(
        F.sum(hits).alias("vrais_positifs"),
        F.sum(F.size(kept) - hits).alias("faux_positifs"),
        F.sum(F.size(F.array_distinct(truth)) - hits).alias("faux_negatifs"),
    )
    double_tp = 2 * F.col("vrais_positifs")
    whole = double_tp + F.col("faux_positifs") + F.col("faux_negatifs")
    return sums.withColumn("micro_f1", F.when(whole > 0, round_half_up(double_tp / whole, 4))).orderBy("seuil")
