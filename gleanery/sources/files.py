"""File formats the jobs read and write."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ARTICLE_SCHEMA, EVENT_SCHEMA, EXTRACT_COLUMNS, EXTRACT_SCHEMA, LEGACY_SCHEMA

_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def read_extract_csv(spark: SparkSession, path: str, schema: T.StructType = EXTRACT_SCHEMA) -> DataFrame:
    """The batch extract: explicit schema, quoted cells that may span lines.

    Cells over several lines make a file one task, so large extracts come as many files.
    """
    return spark.read.schema(schema).options(**_CSV).csv(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV folder with headers; one file only on request, since that takes one task."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(**_CSV).csv(path)


def extract_columns(articles: DataFrame) -> DataFrame:
    """The nine columns of the batch extract."""
    return articles.select(*EXTRACT_COLUMNS)


def envelope_rows(texts: DataFrame, row: T.StructType = ARTICLE_SCHEMA) -> DataFrame:
    """Rows of database exports, one text in ``value`` per export.

    Shape: ``[{"results": [...], "success": .., "meta": {..}}, ...]``; only the first element counts.
    """
    schema = T.StructType([T.StructField("results", T.ArrayType(row))])
    return texts.select(F.inline(F.from_json("value", T.ArrayType(schema))[0]["results"]))


def read_envelope(spark: SparkSession, path: str, row: T.StructType = ARTICLE_SCHEMA) -> DataFrame:
    """Rows of export files. A file is one JSON value and so one task: large exports come as many."""
    return envelope_rows(spark.read.text(path, wholetext=True), row)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Incoming events, one JSON object per line."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def read_legacy(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Articles of the former file format: a JSON array per file, or one object per line."""
    return spark.read.schema(LEGACY_SCHEMA).option("multiLine", multi_line).json(path)


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """``id, themes`` of a JSON map file ``{"<id>": ["label", ...]}``."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, array<string>>")
    return whole.select(F.explode(entries).alias("cle", "themes")).select(F.col("cle").cast("long").alias("id"), "themes")


def write_sample(sheet: DataFrame, path: str) -> None:
    """Annotation sample as JSON lines."""
    sheet.write.mode("overwrite").json(path)


class BadHeader(ValueError):
    """Raised when an annotation file does not start with its header."""


def read_annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ligne, texte`` of an annotation file: BOM and blank lines dropped, header checked.

    Lines are numbered from 1 (the header) in file order without bringing the file together: each
    split is numbered on its own and shifted by the number of lines in the splits before it.
    """
    text = spark.read.text(path).select(
        F.regexp_replace("value", r"^\uFEFF|\r$", "").alias("texte"),
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("m"),
    )
    numbered = number_in_order(text.where(F.trim("texte").rlike(r"\S")), ["f", "b"], "m")
    header = numbered.where(F.col("ligne") == 1).select("texte").collect()
    if not header or not _is_header(header[0][0]):
        raise BadHeader("expected the header id,themes_manuels")
    return numbered.where(F.col("ligne") > 1)


def number_in_order(rows: DataFrame, split: list[str], within: str) -> DataFrame:
    """``ligne, texte``: consecutive numbers by ``split`` then ``within``, split by split."""
    counts = rows.groupBy(*split).agg(F.count("*").alias("n"))
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*split, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    rank: Column = F.row_number().over(Window.partitionBy(*split).orderBy(within))
    local = rows.withColumn("r", rank)
    return local.join(shifts, split).select((F.col("r") + F.col("shift")).alias("ligne"), "texte")


def _is_header(line: str) -> bool:
    # Fixed format of the annotation files: the names of the two columns.
    return re.match(r"id\s*,\s*themes_manuels", line, re.IGNORECASE) is not None
