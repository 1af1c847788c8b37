"""Data model: schemas and the fixed values every job shares."""

from __future__ import annotations

from pyspark.sql import types as T

# The seven reference labels in their reporting order, each with the
# hypothesis text the zero-shot classifier is given for it.
LABEL_HYPOTHESES: dict[str, str] = {
    "IA/ML": "intelligence artificielle et machine learning",
    "DevOps/Infrastructure": "DevOps, cloud et infrastructure",
    "Architecture": "architecture logicielle et conception de systèmes",
    "Sécurité": "sécurité informatique et cybersécurité",
    "Développement": "développement logiciel et programmation",
    "Pratiques/Qualité": "pratiques d'ingénierie, tests et qualité logicielle",
    "Productivité/Outils": "productivité et outils pour développeurs",
}
LABELS: list[str] = list(LABEL_HYPOTHESES)

# Thresholds of the data contract.
SCORE_THRESHOLD = 0.7
FRESH_OK_DAYS = 3
FRESH_ALERT_DAYS = 14
LATE_HOURS = 24
MIN_SUPPORT = 5
TOP_PAIRS = 50
SAMPLE_TARGET = 100
ERA_BOUNDARY = "2026-04-01"
UNKNOWN_SOURCE = "inconnu"

# The columns of the stored table and of the files it is fed from.
ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("titre", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("resume", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("categorie_mistral", T.StringType()),
        T.StructField("score_mistral", T.IntegerType()),
        T.StructField("themes_mistral", T.StringType()),
        T.StructField("themes_ml", T.StringType()),
        T.StructField("score_confiance_ml", T.DoubleType()),
        T.StructField("tags", T.StringType()),
        T.StructField("date_article", T.StringType()),
        T.StructField("date_collecte", T.StringType()),
    ]
)

EXTRACT_COLUMNS = [
    "id",
    "titre",
    "url",
    "source",
    "date_article",
    "themes_mistral",
    "themes_ml",
    "score_confiance_ml",
    "tags",
]
EXTRACT_SCHEMA = T.StructType([ARTICLE_SCHEMA[c] for c in EXTRACT_COLUMNS])

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("resume", T.StringType()),
        T.StructField("categorie", T.StringType()),
        T.StructField("score", T.StringType()),  # as written: 3, 3.0 and "3" are one score
        T.StructField("date", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("themes", T.ArrayType(T.StringType())),
    ]
)

LEGACY_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("resume", T.StringType()),
        T.StructField("categorie", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("analyzedAt", T.StringType()),
    ]
)
