"""Row decoding and the projections that turn raw records into article rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_text, moment, normalize_date
from ..functions.jsonarrays import empty_array, parse_json_array
from ..functions.text import blank_to_null, normalize_tags, whole_number, zero_to_null
from ..model import UNKNOWN_SOURCE


def decode_rows(articles: DataFrame) -> DataFrame:
    """Label and tag texts as arrays: absent becomes ``[]``, except second labels which stay NULL."""
    return articles.withColumns(
        {
            "themes_mistral": parse_json_array(F.col("themes_mistral"), empty_array()),
            "themes_ml": parse_json_array(F.col("themes_ml")),
            "tags": parse_json_array(F.col("tags"), empty_array()),
        }
    )


def reject_reason(title: str = "title", link: str = "link"):
    """Why an event cannot be stored, NULL when it can."""
    title_missing = F.coalesce(F.col(title), F.lit("")) == ""
    link_missing = F.coalesce(F.col(link), F.lit("")) == ""
    return (
        F.when(title_missing & link_missing, F.lit("title and link missing"))
        .when(title_missing, F.lit("title missing"))
        .when(link_missing, F.lit("link missing"))
    )


def from_events(events: DataFrame, now: str | dt.datetime, *keep: str) -> DataFrame:
    """Article rows (without id) of incoming events; empty text and zero scores count as missing.

    Columns named in ``keep`` are carried along unchanged.
    """
    return events.select(
        *keep,
        F.col("title").alias("titre"),
        F.col("link").alias("url"),
        blank_to_null(F.col("resume")).alias("resume"),
        F.coalesce(blank_to_null(F.col("source")), F.lit(UNKNOWN_SOURCE)).alias("source"),
        blank_to_null(F.col("categorie")).alias("categorie_mistral"),
        zero_to_null(whole_number(F.col("score"))).alias("score_mistral"),
        F.to_json("themes").alias("themes_mistral"),
        F.lit(None).cast("string").alias("themes_ml"),
        F.lit(None).cast("double").alias("score_confiance_ml"),
        normalize_tags(F.col("tags")).alias("tags"),
        normalize_date(F.col("date")).alias("date_article"),
        iso_text(moment(now)).alias("date_collecte"),
    )


def candidates(events: DataFrame) -> DataFrame:
    """Events that can be stored, as they came but for the link, which is the ``url`` that new ones are told by."""
    return events.where(reject_reason().isNull()).withColumnRenamed("link", "url")


def from_candidates(rows: DataFrame, now: str | dt.datetime, *keep: str) -> DataFrame:
    """Article rows (without id) of :func:`candidates`."""
    return from_events(rows.withColumnRenamed("url", "link"), now, *keep)


def from_legacy(records: DataFrame, now: str | dt.datetime, *keep: str) -> DataFrame:
    """Article rows of the former file format; values are kept as they are, zero scores included.

    A record without title, link or source breaks a NOT NULL rule of the table and is left out.
    """
    kept = records.where(reject_reason().isNull() & F.col("source").isNotNull())
    collected = F.coalesce(blank_to_null(F.col("analyzedAt")), iso_text(moment(now)))
    return kept.select(
        *keep,
        F.col("title").alias("titre"),
        F.col("link").alias("url"),
        "resume",
        "source",
        F.col("categorie").alias("categorie_mistral"),
        F.col("score").cast("int").alias("score_mistral"),
        F.lit(None).cast("string").alias("themes_mistral"),
        F.lit(None).cast("string").alias("themes_ml"),
        F.lit(None).cast("double").alias("score_confiance_ml"),
        F.coalesce(F.to_json("tags"), F.lit("[]")).alias("tags"),
        F.col("date").alias("date_article"),
        collected.alias("date_collecte"),
    )
