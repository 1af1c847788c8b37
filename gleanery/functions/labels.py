"""Labels: score mapping, canonical subsets and orders, list texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LABEL_HYPOTHESES, LABELS, SCORE_THRESHOLD
from .text import strip_white


def label_array(labels: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels]).cast("array<string>")


def score_pairs(response: Column) -> Column:
    """``array<struct<label, score>>`` of a classifier response text in either accepted form.

    Forms: ``{"labels": [...], "scores": [...]}`` and ``[{"label": .., "score": ..}]``.
    Elements that are not a text label with a numeric score get NULL in that field.
    """
    body = F.try_parse_json(response)
    labels = F.try_variant_get(body, "$.labels", "array<variant>")
    scores = F.try_variant_get(body, "$.scores", "array<variant>")
    zipped = F.transform(
        F.arrays_zip(labels.alias("label"), scores.alias("score")),
        lambda p: F.struct(_text(p["label"]).alias("label"), _number(p["score"]).alias("score")),
    )
    listed = F.transform(
        F.try_variant_get(body, "$", "array<variant>"),
        lambda v: F.struct(
            _text(F.try_variant_get(v, "$.label", "variant")).alias("label"),
            _number(F.try_variant_get(v, "$.score", "variant")).alias("score"),
        ),
    )
    return F.coalesce(listed, zipped)


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    numeric = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(v, "$", "double"))


def zip_scores(labels: Column, scores: Column) -> Column:
    """Pairs from two parallel arrays; a missing score leaves NULL."""
    return F.transform(
        F.arrays_zip(labels.alias("label"), scores.alias("score")),
        lambda p: F.struct(p["label"].alias("label"), p["score"].cast("double").alias("score")),
    )


def usable_scores(pairs: Column, hypotheses: Mapping[str, str] = LABEL_HYPOTHESES) -> Column:
    """Pairs whose hypothesis text is known, renamed to their label; input order kept."""
    entries = [F.lit(x) for label, text in hypotheses.items() for x in (text, label)]
    named = F.transform(
        pairs,
        lambda p: F.struct(F.try_element_at(F.create_map(*entries), p["label"]).alias("label"), p["score"].alias("score")),
    )
    return F.filter(named, lambda p: p["label"].isNotNull() & p["score"].isNotNull())


def kept_labels(usable: Column, threshold: float = SCORE_THRESHOLD) -> Column:
    """Labels at or above the threshold; NULL when no pair was usable."""
    kept = F.transform(F.filter(usable, lambda p: p["score"] >= threshold), lambda p: p["label"])
    return F.when(F.size(usable) > 0, kept)


def top_score(usable: Column) -> Column:
    """Best score, also when below the threshold."""
    return F.array_max(F.transform(usable, lambda p: p["score"]))


def round_half_up(value: Column, places: int) -> Column:
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def canonical_only(items: Column, labels: Sequence[str] = LABELS) -> Column:
    """Elements of the label set, in their own order; empty when the array is absent."""
    return F.coalesce(F.filter(items, lambda t: t.isin(list(labels))), F.array().cast("array<string>"))


def canonical_order(items: Column, labels: Sequence[str] = LABELS) -> Column:
    """Distinct elements of the label set in reporting order."""
    return F.filter(label_array(labels), lambda t: F.array_contains(items, t))


def join_labels(items: Column, labels: Sequence[str] = LABELS) -> Column:
    return F.array_join(canonical_order(items, labels), "|")


def split_labels(cell: Column) -> Column:
    """Elements of a ``|``-separated cell: one outer quote dropped on each side, blanks dropped."""
    # Fixed format of the annotation files: cells may stand in quotes.
    bare = F.regexp_replace(F.coalesce(cell, F.lit("")), '^"|"$', "")
    parts = F.transform(F.split(bare, r"\|", -1), strip_white)
    return F.filter(parts, lambda t: t != "")


def out_of_reference(label: Column, labels: Sequence[str] = LABELS) -> Column:
    return ~label.isin(list(labels))
