"""Calendar, daily aggregate, trends, regularity."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.operators import kpi, star
from gleanery.operators.trends import weekly_trend

from .conftest import as_tuples

DAY = "2026-01-15"


def totals(rows):
    found = star.daily_aggregate(rows).where("est_total").orderBy("date")
    return [(str(r["date"]), r["nb_articles"], r["score_moyen"]) for r in found.collect()]


def themes(rows):
    found = star.daily_aggregate(rows).where("not est_total").orderBy("date", "thematique")
    return [(r["thematique"], r["nb_articles"]) for r in found.collect()]


BASE = {"themes_mistral": '["Architecture"]', "score_mistral": 3, "date_article": f"{DAY}T00:00:00.000Z"}


@pytest.mark.parametrize(
    ("changes", "expected_totals", "expected_themes"),
    [
        ([{}], [(DAY, 1, 3.0)], [("Architecture", 1)]),
        ([{}, {"score_mistral": 5}], [(DAY, 2, 4.0)], [("Architecture", 2)]),
        ([{"themes_mistral": '["a","b","c"]'}], [(DAY, 1, 3.0)], [("a", 1), ("b", 1), ("c", 1)]),
        ([{"themes_mistral": None}, {"themes_mistral": "[]"}, {"themes_mistral": "[null]"}], [(DAY, 3, 3.0)], []),
        ([{"themes_mistral": '["a","a"]'}], [(DAY, 1, 3.0)], [("a", 2)]),
        ([{"date_article": None}, {"date_article": "pas-une-date"}], [], []),
        ([{"score_mistral": None}], [(DAY, 1, None)], [("Architecture", 1)]),
        ([{"score_mistral": None}, {}], [(DAY, 2, 3.0)], [("Architecture", 2)]),
        (
            [{}, {"date_article": f"{DAY}T23:59:59.999Z"}, {"date_article": "2026-01-16T00:00:00.000Z"}],
            [(DAY, 2, 3.0), ("2026-01-16", 1, 3.0)],
            [("Architecture", 2), ("Architecture", 1)],
        ),
        ([{"date_article": "2026-06-30T00:30:00+02:00"}], [("2026-06-29", 1, 3.0)], [("Architecture", 1)]),
    ],
)
def test_daily_aggregate(make_articles, changes, expected_totals, expected_themes):
    rows = make_articles(*[{**BASE, **c} for c in changes])
    assert totals(rows) == expected_totals
    assert themes(rows) == expected_themes


def test_totals_count_dated_rows_once(make_articles):
    rows = make_articles(BASE, {**BASE, "themes_mistral": '["a","b"]'}, {**BASE, "date_article": None})
    assert sum(n for _, n, _ in totals(rows)) == 2


def test_calendar(make_articles):
    assert as_tuples(star.calendar(make_articles(BASE, BASE, {"date_article": None}))) == [
        (dt.date(2026, 1, 15), 2026, 1, 2, 4)
    ]


def test_timeline_and_derived_views(make_articles):
    rows = make_articles(BASE, {**BASE, "themes_mistral": '["a","b"]', "date_article": "2026-02-03T00:00:00.000Z"})
    aggregate = star.daily_aggregate(rows)
    assert as_tuples(star.timeline(aggregate)) == [(dt.date(2026, 1, 15), 1), (dt.date(2026, 2, 3), 1)]
    assert as_tuples(star.theme_counts_from_aggregate(aggregate)) == [("Architecture", 1), ("a", 1), ("b", 1)]
    assert as_tuples(star.theme_trend(aggregate)) == [("2026-01", "Architecture", 1), ("2026-02", "a", 1), ("2026-02", "b", 1)]


def test_crosscheck_sees_both_sides(make_articles):
    rows = make_articles(BASE, {**BASE, "date_article": "2026-01-20T00:00:00.000Z"})
    assert star.crosscheck(star.daily_aggregate(rows), rows).count() == 0
    moved = rows.withColumn("date_article", F.when(F.col("id") == 1, F.lit("2026-01-21T00:00:00.000Z")).otherwise(F.col("date_article")))
    found = sorted(as_tuples(star.crosscheck(star.daily_aggregate(rows), moved)), key=str)
    assert sorted(found, key=lambda r: r[0] or dt.date.max) == [
        (dt.date(2026, 1, 15), 1, None),
        (dt.date(2026, 1, 21), None, 1),
    ]


def test_weekly_trend_counts_present_weeks_only(spark):
    weeks = {"2025-08-07": 2, "2025-08-14": 1, "2025-08-21": 4, "2025-09-18": 3, "2025-09-25": 4}
    rows = [(f"{week} 12:00:00",) for week, n in weeks.items() for _ in range(n)]
    df = spark.createDataFrame([*rows, (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = [(str(r[0]), r[1], r[2]) for r in weekly_trend(df, "t").collect()]
    means = [2.0, 1.5, 2.33, 2.5, 3.0]
    assert got == [(week, n, mean) for (week, n), mean in zip(weeks.items(), means)]


def test_gap_regularity(spark):
    rows = [("a", "2026-01-01"), ("a", "2026-01-01"), ("a", "2026-01-03"), ("a", "2026-01-04"), ("a", "2026-01-14"), ("b", "2026-01-01")]
    df = spark.createDataFrame(rows, "ere string, d string").withColumn("d", F.to_date("d"))
    assert as_tuples(kpi.gap_regularity(df, "ere", "d")) == [("a", 4.3, 2.0, 10)]


def test_collection_regularity(spark):
    df = spark.createDataFrame([("2026-01-01",), ("2026-01-03",), ("2026-01-03",)], "d string").withColumn("d", F.to_date("d"))
    assert as_tuples(star.collection_regularity(df, "d")) == [(2, 3, 66.7)]


def test_process_kpis(make_articles):
    def row(day, **more):
        return {"date_collecte": f"{day}T12:00:00.000Z", "date_article": f"{day}T00:00:00.000Z", **more}

    rows = make_articles(
        row("2026-03-01", score_mistral=3, categorie_mistral="PRO", themes_mistral="[]"),
        row("2026-03-01", score_mistral=4, categorie_mistral="HORS_SCOPE", source="hn"),
        row("2026-03-05", score_mistral=None, categorie_mistral=None, date_article=None),
        row("2026-04-01"),
        row("2026-04-03"),
        {**row("2026-04-03"), "score_mistral": 5},
    )
    before, after = sorted((r.asDict() for r in kpi.process_kpis(rows).collect()), key=lambda r: r["ere"], reverse=True)
    assert before == {
        "ere": "avant", "articles": 3, "passes": 2,
        "premiere_collecte": dt.date(2026, 3, 1), "derniere_collecte": dt.date(2026, 3, 5), "etendue_j": 4,
        "articles_par_passe": 1.5, "age_moyen_j": 0.5, "pct_score_3": 33.3, "pct_score_4": 33.3,
        "notes_1_ou_2": 0, "notes_5": 0, "categories_distinctes": 2, "hors_scope": 1, "sources_distinctes": 2,
        "sans_theme": 2, "intervalle_moyen_j": 4.0, "intervalle_median_j": 4.0, "plus_longue_interruption_j": 4,
    }
    assert (after["ere"], after["notes_5"], after["hors_scope"], after["categories_distinctes"]) == ("apres", 1, None, 0)
    # A single collection day leaves no gap, so the era is not reported.
    assert kpi.process_kpis(rows.where("id = 4")).count() == 0
