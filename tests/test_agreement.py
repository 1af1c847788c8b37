"""Agreement between annotators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.model import LABELS
from gleanery.operators import agreement

from .conftest import as_tuples


def pair(spark, *rows):
    return spark.createDataFrame(rows, "themes_mistral string, themes_ml string")


def overall(df, **how):
    return as_tuples(agreement.agreement_global(df, "themes_mistral", "themes_ml", **how))[0]


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ('["IA/ML","Sécurité"]', '["Sécurité","IA/ML"]', (1, 1, 1, 1, 1.0)),
        ('["IA/ML","Sécurité"]', '["IA/ML","Développement"]', (1, 1, 0, 1, 0.333)),
        ('["Sécurité"]', '["Développement"]', (1, 1, 0, 0, 0.0)),
        ("[]", "[]", (1, 1, 1, 0, 1.0)),
        (None, '["IA/ML"]', (1, 0, 0, 0, 0.0)),
        ('["IA/ML"', '["IA/ML"]', (1, 0, 0, 0, 0.0)),
        ('["IA/ML","IA/ML",3]', '["IA/ML"]', (1, 1, 1, 1, 1.0)),
    ],
)
def test_global(spark, a, b, expected):
    assert overall(pair(spark, (a, b))) == expected


def test_mean_leaves_excluded_rows_out(spark):
    rows = pair(spark, ('["a"]', '["a"]'), ('["a"]', '["b"]'), ('["a"]', None))
    assert overall(rows) == (3, 2, 1, 1, 0.5)
    assert overall(rows.limit(0)) == (0, 0, 0, 0, 0.0)


def test_by_label_keeps_order_and_zeros(spark):
    rows = pair(spark, ('["IA/ML","Sécurité","IoT"]', '["IA/ML"]'), ("[]", '["Développement"]'), ('["IA/ML"]', None))
    got = as_tuples(agreement.agreement_by_label(rows, "themes_mistral", "themes_ml"))
    counts = {"IA/ML": (1, 0, 0), "Sécurité": (0, 1, 0), "Développement": (0, 0, 1)}
    assert got == [(i, t, *counts.get(t, (0, 0, 0))) for i, t in enumerate(LABELS)]


def test_symmetry(spark):
    rows = pair(spark, ('["a","b"]', '["b"]'), ('["a"]', "[]"), ("[]", "[]"))
    swapped = rows.select(F.col("themes_ml").alias("themes_mistral"), F.col("themes_mistral").alias("themes_ml"))
    assert overall(rows) == overall(swapped)
    one = as_tuples(agreement.agreement_by_label(rows, "themes_mistral", "themes_ml", ["a", "b"]))
    two = as_tuples(agreement.agreement_by_label(swapped, "themes_mistral", "themes_ml", ["a", "b"]))
    assert [(r[1], r[2], r[4], r[3]) for r in one] == [r[1:] for r in two]


def test_concordance_scores_empty_pairs_zero(spark):
    rows = pair(spark, ("[]", "[]"), ('["IA/ML"]', '["IA/ML"]'), ('["IA/ML"]', '["Sécurité"]'))
    assert as_tuples(agreement.concordance(rows, "themes_mistral", "themes_ml")) == [(3, 2, 67, 0.333)]


def test_micro_f1(spark):
    rows = spark.createDataFrame(
        [(["a"], [("a", 0.9), ("b", 0.75)]), (["a", "b"], [("b", 0.5)])],
        "t array<string>, u array<struct<label string, score double>>",
    )
    got = as_tuples(agreement.micro_f1(rows, "t", "u", [0.7, 0.5]))
    assert got == [(0.5, 2, 1, 1, 0.6667), (0.7, 1, 1, 2, 0.4)]
