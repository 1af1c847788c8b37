"""Queries that read articles back: search, counts, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import in_day
from ..operators import search as s
from ..operators import stats
from ..operators.normalize import decode_rows
from ..operators.paging import PageIndex
from .catalog import Query
from .views import ARTICLES_SQL, articles

FIRST_PAGE = {"categorie": "PRO", "score_min": "2"}
ML_PAGE = {"theme_ml": "Sécurité", "score_ml_min": "0.1", "ml": "oui", "theme": "IA/ML"}

_ROW = """id, titre, url, resume, source, categorie_mistral, score_mistral,
  coalesce(array_to_string(m, '|'), '') AS themes_mistral, array_to_string(b, '|') AS themes_ml,
  score_confiance_ml, array_to_string(t, '|') AS tags, date_article, date_collecte"""
_ORDER = "ORDER BY date_article DESC NULLS LAST, date_collecte DESC, id"


def _flat(rows: DataFrame) -> DataFrame:
    """Decoded rows with arrays as joined text; a NULL array stays NULL."""
    return decode_rows(rows).withColumns({c: F.array_join(c, "|") for c in ("themes_mistral", "themes_ml", "tags")})


def _page(params: dict, page: str, limit: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _flat(s.page(s.search(articles(spark, folder), **params), page, limit))

    return run


def _page_after(spark: SparkSession, folder: str) -> DataFrame:
    """The page behind the last row of page 9."""
    found = s.search(articles(spark, folder), ml="oui")
    return _flat(s.page_after(found, s.page(found, "9", "100").collect()[-1], "100"))


def _page_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same page from an index over the pages of the result."""
    found = s.search(articles(spark, folder), ml="oui")
    return _flat(PageIndex.build(found).page("10", "100"))


def _day(spark: SparkSession, folder: str) -> DataFrame:
    a = articles(spark, folder)
    return a.where(in_day(F.col("date_article"), "1995-01-05")).select("id", "url", "date_article")


def _total(spark: SparkSession, folder: str) -> DataFrame:
    return s.pagination(s.search(articles(spark, folder), **FIRST_PAGE), "3", "20")


def _filtered(**params):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return s.search(articles(spark, folder), **params).select("id", "url")

    return run


def _queue(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.classify import model_inputs

    return model_inputs(s.unclassified(articles(spark, folder))).select("id", "texte")


def _theme_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.theme_counts(articles(spark, folder))


def _source_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.source_counts(articles(spark, folder))


def _frequency(spark: SparkSession, folder: str) -> DataFrame:
    return stats.theme_frequency(articles(spark, folder), {"mistral": "themes_mistral", "ml": "themes_ml"})


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return stats.corpus_profile(articles(spark, folder))


def _bounds(spark: SparkSession, folder: str) -> DataFrame:
    return stats.batch_bounds(articles(spark, folder))


TAG_THEMES = {"etat-o": "Développement", "etat-f": "DevOps/Infrastructure", "grand compte": "Architecture"}


def _frequent_tags(spark: SparkSession, folder: str) -> DataFrame:
    return stats.frequent_tags(articles(spark, folder), TAG_THEMES)


def _sql(body: str) -> str:
    return f"WITH {ARTICLES_SQL}\n{body}"


QUERIES = {
    "search_page": Query(
        _page(FIRST_PAGE, "3", "20"),
        _sql(f"SELECT {_ROW} FROM articles WHERE categorie_mistral = 'PRO' AND score_mistral >= 2 {_ORDER} LIMIT 20 OFFSET 40"),
    ),
    "search_page_second_labels": Query(
        _page(ML_PAGE, "1", "abc"),
        _sql(
            f"""SELECT {_ROW} FROM articles WHERE list_contains(b, 'Sécurité') AND score_confiance_ml >= 0.1
            AND b IS NOT NULL AND list_contains(m, 'IA/ML') {_ORDER} LIMIT 20"""
        ),
    ),
    "search_far_page": Query(
        _page({"ml": "oui"}, "10", "100"),
        _sql(f"SELECT {_ROW} FROM articles WHERE b IS NOT NULL {_ORDER} LIMIT 100 OFFSET 900"),
    ),
    "search_page_after": Query(
        _page_after, _sql(f"SELECT {_ROW} FROM articles WHERE b IS NOT NULL {_ORDER} LIMIT 100 OFFSET 900")
    ),
    "search_page_indexed": Query(
        _page_indexed, _sql(f"SELECT {_ROW} FROM articles WHERE b IS NOT NULL {_ORDER} LIMIT 100 OFFSET 900")
    ),
    "day_slice": Query(
        _day,
        _sql("SELECT id, url, date_article FROM articles WHERE date_article >= '1995-01-05' AND date_article < '1995-01-06'"),
    ),
    "search_total": Query(
        _total,
        _sql(
            """SELECT 3 AS page, 20 AS "limit", count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS "totalPages"
            FROM articles WHERE categorie_mistral = 'PRO' AND score_mistral >= 2"""
        ),
    ),
    "filter_source": Query(
        _filtered(source="client-7"), _sql("SELECT id, url FROM articles WHERE source = 'client-7'")
    ),
    "filter_unlabelled": Query(_filtered(ml="non"), _sql("SELECT id, url FROM articles WHERE b IS NULL")),
    "filter_disagreement": Query(
        _filtered(desaccord="1"),
        _sql("SELECT id, url FROM articles WHERE m IS NOT NULL AND b IS NOT NULL AND NOT list_has_any(m, b)"),
    ),
    "classification_queue": Query(
        _queue,
        _sql("SELECT id, trim(titre || '. ' || coalesce(resume, '')) AS texte FROM articles WHERE themes_ml IS NULL"),
    ),
    "theme_counts": Query(
        _theme_counts,
        _sql("SELECT theme, count(*) AS nb FROM (SELECT unnest(m) AS theme FROM articles) GROUP BY theme"),
    ),
    "source_counts": Query(_source_counts, _sql("SELECT source, count(*) AS nb FROM articles GROUP BY source")),
    "theme_frequency_by_annotator": Query(
        _frequency,
        _sql(
            """SELECT theme, source_annotation, count(*) AS nb, theme = 'Produktivité/Outils' AS hors_referentiel
            FROM (SELECT unnest(m) AS theme, 'mistral' AS source_annotation FROM articles
                  UNION ALL SELECT unnest(b), 'ml' FROM articles) GROUP BY ALL"""
        ),
    ),
    "corpus_profile": Query(
        _profile,
        _sql(
            """SELECT count(*) AS articles, count(*) FILTER (tags <> '[]') AS avec_tags,
              (SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM articles)) AS tags_distincts,
              min(date_article) AS premiere_date, max(date_article) AS derniere_date,
              count(*) FILTER (date_article IS NULL) AS sans_date FROM articles"""
        ),
    ),
    "batch_bounds": Query(
        _bounds,
        _sql(
            """SELECT count(*) AS nb_articles, min(date_article) AS premiere_date,
            max(date_article) AS derniere_date FROM articles"""
        ),
    ),
    "frequent_tags": Query(
        _frequent_tags,
        _sql(
            """SELECT CASE tag WHEN 'etat-o' THEN 'Développement' WHEN 'etat-f' THEN 'DevOps/Infrastructure'
                 WHEN 'grand compte' THEN 'Architecture' END AS theme,
              count(*) AS tags, CAST(sum(nb) AS BIGINT) AS occurrences
            FROM (SELECT tag, count(*) AS nb FROM (SELECT unnest(t) AS tag FROM articles) GROUP BY tag)
            WHERE nb >= 3 GROUP BY 1"""
        ),
    ),
}
