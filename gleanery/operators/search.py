"""Filtered, paged reading of articles."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_of
from ..functions.jsonarrays import as_array, as_label_set, is_array
from ..functions.sets import disjoint, has_label

DEFAULT_LIMIT = 20
MAX_LIMIT = 100


def leading_int(value: object) -> int | None:
    """Integer prefix of a request parameter, None when it has none."""
    found = re.match(r"\s*([+-]?\d+)", str(value)) if value is not None else None
    return int(found.group(1)) if found else None


def leading_float(value: object) -> float | None:
    """Decimal prefix of a request parameter, None when it has none."""
    pattern = r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    found = re.match(pattern, str(value)) if value is not None else None
    return float(found.group(1)) if found else None


def page_bounds(page: object = None, limit: object = None) -> tuple[int, int]:
    """Page at least 1, limit within 1..100; zero or garbage fall back to the default."""
    number = max(1, leading_int(page) or 1)
    size = min(MAX_LIMIT, max(1, leading_int(limit) or DEFAULT_LIMIT))
    return number, size


def _carries(articles: DataFrame, column: str, label: str) -> Column:
    """The label is an element of the column's array."""
    exact = has_label(as_array(articles, column), label)
    if is_array(articles, column):
        return exact
    # A JSON text holds its strings literally or with backslash escapes, so a plain search spares
    # parsing the rows that cannot match.
    text = F.col(column)
    return (text.contains(label) | text.contains("\\")) & exact


def conditions(
    articles: DataFrame,
    theme: str | None = None,
    source: str | None = None,
    categorie: str | None = None,
    score_min: object = None,
    theme_ml: str | None = None,
    score_ml_min: object = None,
    ml: str | None = None,
    desaccord: str | None = None,
    strict_disagreement: bool = False,
) -> list[Column]:
    """One predicate per parameter present; empty or unreadable parameters filter nothing.

    ``strict_disagreement`` leaves out rows where both label sets are empty, which the default
    reports as disagreeing.
    """
    found: list[Column] = []
    if theme:
        found.append(_carries(articles, "themes_mistral", theme))
    if source:
        found.append(F.col("source") == source)
    if categorie:
        found.append(F.col("categorie_mistral") == categorie)
    if (score := leading_int(score_min)) is not None:
        found.append(F.col("score_mistral") >= score)
    if theme_ml:
        found.append(_carries(articles, "themes_ml", theme_ml))
    if (confidence := leading_float(score_ml_min)) is not None:
        found.append(F.col("score_confiance_ml") >= confidence)
    if ml == "oui":
        found.append(F.col("themes_ml").isNotNull())
    elif ml == "non":
        found.append(F.col("themes_ml").isNull())
    if desaccord == "1":
        a, b = as_label_set(articles, "themes_mistral"), as_label_set(articles, "themes_ml")
        found.append(disjoint(a, b))
        if strict_disagreement:
            found.append((F.size(a) > 0) | (F.size(b) > 0))
    return found


def search(articles: DataFrame, **params: object) -> DataFrame:
    """Rows meeting every given condition."""
    found = conditions(articles, **params)
    return articles.where(reduce(lambda a, b: a & b, found)) if found else articles


def total(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"))


def newest_first() -> list[Column]:
    return [F.desc("date_article"), F.desc("date_collecte"), F.asc("id")]


def page(found: DataFrame, page: object = None, limit: object = None) -> DataFrame:
    """One page, newest first, ties by id. One lazy plan at any depth; nothing runs before it is read.

    The rows before a page are ranked with it, so its cost grows with its depth. Who walks far
    through a result goes on from the last row seen: :func:`page_after`.
    """
    number, size = page_bounds(page, limit)
    return found.orderBy(*newest_first()).offset((number - 1) * size).limit(size)


def page_after(found: DataFrame, last: Mapping | None, limit: object = None) -> DataFrame:
    """The page that follows the row ``last`` (its date_article, date_collecte and id); the first page for None.

    Earlier rows are filtered out by key, so every page is a small top-k, however far it lies.
    """
    size = page_bounds(None, limit)[1]
    if last is not None:
        found = found.where(_behind(last["date_article"], last["date_collecte"], last["id"]))
    return found.orderBy(*newest_first()).limit(size)


def _behind(article: str | None, collected: str | None, row_id: int) -> Column:
    """Later in page order than the given key: descending texts with missing ones last, then ascending ids."""

    def lower(name: str, value: str | None) -> Column:
        return F.lit(False) if value is None else (F.col(name) < F.lit(value)) | F.col(name).isNull()

    same_article = F.col("date_article").eqNullSafe(F.lit(article))
    same_both = same_article & F.col("date_collecte").eqNullSafe(F.lit(collected))
    return (
        lower("date_article", article)
        | (same_article & lower("date_collecte", collected))
        | (same_both & (F.col("id") > F.lit(row_id)))
    )


def pagination(found: DataFrame, page: object = None, limit: object = None) -> DataFrame:
    """``page, limit, total, totalPages`` of a search."""
    number, size = page_bounds(page, limit)
    return total(found).select(
        F.lit(number).alias("page"),
        F.lit(size).alias("limit"),
        "total",
        F.ceil(F.col("total") / size).alias("totalPages"),
    )


def unclassified(articles: DataFrame) -> DataFrame:
    """Queue of the second classifier: rows it has never labelled."""
    return articles.where(F.col("themes_ml").isNull()).select("id", "titre", "resume", "url")


def dated(articles: DataFrame) -> DataFrame:
    """Rows whose publication date is readable, with its UTC day as ``jour``."""
    return articles.withColumn("jour", day_of(F.col("date_article"))).where(F.col("jour").isNotNull())
