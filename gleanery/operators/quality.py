"""Checks of the date contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_text, parse_iso


class ContractBroken(ValueError):
    """Raised by :func:`require_clean` when a check found rows that break a contract."""


def date_contract(articles: DataFrame, column: str = "date_article") -> DataFrame:
    """``total, hors_contrat, sans_date``: texts that differ from their canonical round trip.

    A missing date is not off contract; an unreadable one is.
    """
    raw = F.col(column)
    return articles.agg(
        F.count("*").alias("total"),
        F.count_if(~iso_text(parse_iso(raw)).eqNullSafe(raw)).alias("hors_contrat"),
        F.count_if(raw.isNull()).alias("sans_date"),
    )


def collect_contract(articles: DataFrame, column: str = "date_collecte") -> DataFrame:
    """``total, nulles, non_parsables, hors_format``; a missing date is also unreadable."""
    raw = F.col(column)
    parsed = parse_iso(raw)
    return articles.agg(
        F.count("*").alias("total"),
        F.count_if(raw.isNull()).alias("nulles"),
        F.count_if(parsed.isNull()).alias("non_parsables"),
        F.count_if(~iso_text(parsed).eqNullSafe(raw)).alias("hors_format"),
    )


def require_clean(check: DataFrame, column: str = "hors_contrat") -> None:
    """Raises unless the one-row check counts zero in ``column``."""
    bad = check.select(column).first()[0]
    if bad:
        raise ContractBroken(f"{column}: {bad}")
