"""The documents of a folder, through the corpus operators: five stages, each stored before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, decontam, langid, linededup, neardup
from gleanery.llm.common import materialize
from gleanery.sources.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is fitted on the labels among them."""
    model = langid.fit(spark, docs)
    found = langid.predict(spark, docs, model, prefix="_language_")
    return found.where(~F.col("_language_rejected")).select(*[found[c] for c in docs.columns])


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that fill their source; n_chars follows the text."""
    found = linededup.remove_boilerplate(spark, docs, counts=False)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return neardup.one_of_each(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.remove_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the text they decode to."""
    return bpe.round_trip(spark, docs, with_ids=True)


STAGES = [
    ("language id", known_language),
    ("line dedup", without_boilerplate),
    ("near-duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("byte bpe", encoded),
]

#: Stages learn, hash and tokenize in ways that SQL has no functions for; the tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), spark, name.replace(" ", "-"))
    return docs
