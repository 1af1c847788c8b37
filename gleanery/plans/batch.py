"""The batch report: theme frequencies, tag co-occurrence and weekly trend, written as CSV."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_iso
from ..operators.cooccurrence import item_tags, tag_cooccurrence
from ..operators.stats import batch_bounds, theme_frequency
from ..operators.trends import weekly_trend
from ..session import build_session, ensure_utc
from ..sources.files import read_extract_csv, write_csv

ANNOTATORS = {"mistral": "themes_mistral", "ml": "themes_ml"}


def reports(articles: DataFrame) -> dict[str, DataFrame]:
    """The three analyses by output name."""
    moments = articles.select(parse_iso(F.col("date_article")).alias("ts"))
    return {
        "freq_themes": theme_frequency(articles, ANNOTATORS).withColumnRenamed("nb", "count").select(
            "theme", "source_annotation", "count", "hors_referentiel"
        ),
        "cooccurrences_tags": tag_cooccurrence(item_tags(articles)),
        "tendances_hebdo": weekly_trend(moments, "ts"),
    }


def run(articles: DataFrame, out: str, single_file: bool = False) -> None:
    """Writes each report once, without a second execution to count it."""
    for name, report in reports(articles).items():
        write_csv(report, f"{out}/{name}", single_file)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("extract", help="CSV extract of the articles")
    args.add_argument("out", help="output folder")
    args.add_argument("--single-file", action="store_true")
    given = args.parse_args()
    spark = ensure_utc(build_session("gleanery-batch"))
    articles = read_extract_csv(spark, given.extract)
    batch_bounds(articles).show(truncate=False)
    run(articles, given.out, given.single_file)
    spark.stop()


if __name__ == "__main__":
    main()
