"""Health verdict and date contracts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.operators import health, quality

from .conftest import as_tuples

NOW = dt.datetime(2026, 7, 20, 12, tzinfo=dt.timezone.utc)
COUNTERS = "dernier_article_collecte string, total long, ml_en_retard long, ml_sans_theme long, mistral_manquants long"


def days_ago(days):
    return (NOW - dt.timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def verdict(spark, last, late=0, empty=0, missing=0, total=10):
    return health.judge(spark.createDataFrame([(last, total, late, empty, missing)], COUNTERS), NOW).first()


@pytest.mark.parametrize(
    ("last", "days", "status"),
    [
        (days_ago(0), 0, "ok"),
        (days_ago(3), 3, "ok"),
        (days_ago(4), 4, "degrade"),
        (days_ago(14), 14, "degrade"),
        (days_ago(15), 15, "alerte"),
        (days_ago(67), 67, "alerte"),
        (None, None, "alerte"),
        ("pas-une-date", None, "alerte"),
        (days_ago(-1), 0, "ok"),
    ],
)
def test_freshness(spark, last, days, status):
    out = verdict(spark, last)
    assert (out["collecte"]["jours_depuis"], out["collecte"]["statut"], out["statut"]) == (days, status, status)


def test_classification_is_binary_and_neutral_to_the_rest(spark):
    assert verdict(spark, days_ago(0), late=1)["classification"]["statut"] == "alerte"
    out = verdict(spark, days_ago(0), empty=72, missing=2, total=529)
    assert (out["statut"], out["classification"]["ml_sans_theme"], out["classification"]["total"]) == ("ok", 72, 529)


def test_overall_is_the_worse(spark):
    assert verdict(spark, days_ago(5), late=3)["statut"] == "alerte"
    assert verdict(spark, days_ago(5))["statut"] == "degrade"


def test_report_counts_raw_text(make_articles):
    rows = make_articles(
        {"themes_ml": None, "date_collecte": days_ago(2), "themes_mistral": "[]"},
        {"themes_ml": None, "date_collecte": days_ago(0.5)},
        {"themes_ml": "[]", "date_collecte": days_ago(9)},
        {"themes_ml": '["cut', "date_collecte": days_ago(9)},
    )
    got = health.health_report(rows, NOW).first()
    assert tuple(got["classification"])[:4] == (4, 1, 1, 3)
    twin = health.health_by_dates(rows, NOW).first().asDict()
    assert (twin["total"], twin["ml_en_retard"], twin["statut_collecte"]) == (4, 1, "ok")
    assert health.health_report(rows.limit(0), NOW).first()["statut"] == "alerte"


def test_late_threshold(spark):
    assert spark.range(1).select(health.late_threshold(NOW)).first()[0] == "2026-07-19T12:00:00.000Z"


def test_backtest(spark):
    days = spark.createDataFrame([("2026-01-01",), ("2026-01-21",), ("2026-01-22",)], "d string").select(F.to_date("d").alias("d"))
    assert sorted(as_tuples(health.freshness_backtest(days, "d"))) == [("alerte", 5), ("degrade", 11), ("ok", 6)]


def test_date_contract(make_articles):
    rows = make_articles(
        {"date_article": "2026-01-15T00:00:00.000Z"},
        {"date_article": "2026-06-30T00:30:00+02:00"},
        {"date_article": "2026-01-15"},
        {"date_article": "pas-une-date"},
        {"date_article": None},
    )
    assert as_tuples(quality.date_contract(rows)) == [(5, 3, 1)]
    assert as_tuples(quality.collect_contract(rows, "date_article")) == [(5, 1, 2, 3)]
    with pytest.raises(quality.ContractBroken):
        quality.require_clean(quality.date_contract(rows))
    quality.require_clean(quality.date_contract(rows.where("id = 1")))
