"""Filters, paging and counts."""

from __future__ import annotations

import random

import pytest

from gleanery.operators import search, stats
from gleanery.operators.normalize import decode_rows
from gleanery.operators.paging import PageIndex

from .conftest import as_tuples


@pytest.fixture
def three(make_articles):
    return make_articles(
        {"themes_mistral": '["IA/ML"]', "themes_ml": '["IA/ML"]', "score_confiance_ml": 0.9, "categorie_mistral": "PRO"},
        {"themes_mistral": '["Sécurité"]', "themes_ml": '["Développement"]', "score_confiance_ml": 0.8, "score_mistral": 4},
        {"themes_mistral": '["Architecture"]', "source": "hn", "score_mistral": 2},
    )


@pytest.mark.parametrize(
    ("params", "ids"),
    [
        ({}, [1, 2, 3]),
        ({"theme": "", "source": None, "ml": "peut-être", "desaccord": "0"}, [1, 2, 3]),
        ({"theme": "Architecture"}, [3]),
        ({"source": "hn"}, [3]),
        ({"categorie": "PRO"}, [1]),
        ({"score_min": "3abc"}, [2]),
        ({"score_min": "abc"}, [1, 2, 3]),
        ({"theme_ml": "IA/ML"}, [1]),
        ({"score_ml_min": "0.85"}, [1]),
        ({"score_ml_min": "0.5"}, [1, 2]),
        ({"ml": "oui"}, [1, 2]),
        ({"ml": "non"}, [3]),
        ({"desaccord": "1"}, [2]),
        ({"ml": "oui", "score_min": "1"}, [2]),
    ],
)
def test_filters(three, params, ids):
    assert sorted(r["id"] for r in search.search(three, **params).collect()) == ids


def test_theme_filter_reads_escaped_text(make_articles):
    rows = make_articles(
        {"themes_mistral": '["S\\u00e9curit\\u00e9"]'}, {"themes_mistral": '["IA\\/ML"]'}, {"themes_mistral": '["IA/ML+"]'}, {"themes_mistral": "IA/ML"}
    )
    assert [r["id"] for r in search.search(rows, theme="Sécurité").collect()] == [1]
    assert [r["id"] for r in search.search(rows, theme="IA/ML").collect()] == [2]
    assert [r["id"] for r in search.search(decode_rows(rows), theme="IA/ML").collect()] == [2]


def test_empty_sets_disagree_unless_strict(make_articles):
    both = make_articles({"themes_mistral": "[]", "themes_ml": "[]"}, {"themes_mistral": '["a"]', "themes_ml": "[]"})
    assert search.search(both, desaccord="1").count() == 2
    assert [r["id"] for r in search.search(both, desaccord="1", strict_disagreement=True).collect()] == [2]


@pytest.mark.parametrize(
    ("page", "limit", "bounds"),
    [(None, None, (1, 20)), ("0", "0", (1, 20)), ("-3", "-5", (1, 1)), ("12abc", "500", (12, 100)), ("x", "y", (1, 20))],
)
def test_page_bounds(page, limit, bounds):
    assert search.page_bounds(page, limit) == bounds


def test_pages_follow_each_other(make_articles):
    """Near and far pages agree with a full sort, also when one date holds most rows."""
    rng = random.Random(3)
    dates = [None, "2026-01-15T10:00:00.000Z", "2026-01-15T10:00:01.000Z", "2026-01-14T00:00:00.000Z", "2025-12-01T00:00:00.000Z"]
    rows = [
        {"date_article": dates[min(rng.randrange(9), 4)], "date_collecte": f"2026-02-0{rng.randrange(1, 4)}T00:00:00.000Z"}
        for _ in range(240)
    ]
    articles = make_articles(*rows)
    local = [(r["date_article"], r["date_collecte"], r["id"]) for r in articles.collect()]
    local.sort(key=lambda r: r[2])
    local.sort(key=lambda r: r[1], reverse=True)
    local.sort(key=lambda r: (r[0] is not None, r[0] or ""), reverse=True)
    for page in (1, 4, 17, 24, 25):
        expected = [r[2] for r in local[(page - 1) * 10 : page * 10]]
        assert [r["id"] for r in search.page(articles, page, 10).collect()] == expected
    walked, last = [], None
    while rows := search.page_after(articles, last, 60).collect():
        walked += [r["id"] for r in rows]
        last = rows[-1]
    assert walked == [r[2] for r in local]


def test_pagination(three):
    assert as_tuples(search.pagination(three, "2", "2")) == [(2, 2, 3, 2)]
    assert as_tuples(search.pagination(search.search(three, source="none"))) == [(1, 20, 0, 0)]


def test_decode_keeps_null_and_empty_apart(make_articles):
    rows = make_articles({"themes_ml": None, "tags": None}, {"themes_ml": "[]"}, {"themes_ml": '["ia"', "themes_mistral": "42"})
    got = as_tuples(decode_rows(rows).orderBy("id").select("themes_mistral", "themes_ml", "tags"))
    assert got == [([], None, []), ([], [], []), ([], None, [])]


def test_unclassified_queue(three):
    assert [r["id"] for r in search.unclassified(three).collect()] == [3]


def test_counts(make_articles):
    rows = make_articles(
        {"themes_mistral": '["ia","web","ia",null]'}, {"themes_mistral": '["web"]', "source": "hn"}, {"themes_mistral": "oops"}
    )
    assert as_tuples(stats.theme_counts(rows)) == [("ia", 2), ("web", 2)]
    assert as_tuples(stats.source_counts(rows)) == [("dev.to", 2), ("hn", 1)]


def test_frequency_flags_foreign_labels(make_articles):
    rows = make_articles(
        {"themes_mistral": '["IA/ML","Produktivité/Outils"]', "themes_ml": '["IA/ML"]'}, {"themes_ml": '["IA/ML"]'}
    )
    got = as_tuples(stats.theme_frequency(rows, {"mistral": "themes_mistral", "ml": "themes_ml"}))
    assert got == [("IA/ML", "ml", 2, False), ("IA/ML", "mistral", 1, False), ("Produktivité/Outils", "mistral", 1, True)]


def test_profile(make_articles):
    rows = make_articles(
        {"tags": '["a","b","a"]', "date_article": "2026-01-02"}, {"tags": '["b"]'}, {"tags": "[]"}, {"tags": None}, {"tags": "[null]"}
    )
    assert as_tuples(stats.corpus_profile(rows)) == [(5, 3, 2, "2026-01-02", "2026-01-02", 4)]
    assert as_tuples(stats.corpus_profile(rows.limit(0))) == [(0, 0, 0, None, None, 0)]
    assert as_tuples(stats.batch_bounds(rows)) == [(5, "2026-01-02", "2026-01-02")]


def test_frequent_tags(make_articles):
    rows = make_articles(*[{"tags": '["a","b"]'}] * 3, {"tags": '["b","c"]'})
    assert as_tuples(stats.frequent_tags(rows, {"a": "IA/ML"})) == [(None, 1, 4), ("IA/ML", 1, 3)]


def test_indexed_pages_are_those_of_the_ranking(make_articles):
    rng = random.Random(8)
    day = lambda: rng.choice([None, "2026-01-01", "2026-01-02", "2026-02-01"])
    rows = make_articles(*[{"date_article": day(), "date_collecte": f"2026-03-0{rng.randint(1, 3)}"} for _ in range(230)])
    index = PageIndex.build(rows, slice_rows=25)
    assert index.total == 230 and len(index.slices) > 4
    for number, size in [(1, 7), (2, 100), (3, 100), (4, 100), (23, 10), (24, 10), (9, 13)]:
        got = index.page(number, size)
        assert as_tuples(got) == as_tuples(search.page(rows, number, size))
    deep = index.page(23, 10)
    assert len({f.split("_tranche=")[1].split("/")[0] for f in deep.inputFiles()}) <= 2
    assert PageIndex.build(rows.limit(0)).page(1, 10).collect() == []
