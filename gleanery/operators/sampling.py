"""Deterministic stratified samples, spread over labels and sources."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonarrays import as_array
from ..functions.labels import label_array
from ..model import LABELS, SAMPLE_TARGET
from ..session import work_dir


def _by_label(articles: DataFrame, labels: Sequence[str], extra: str | None = None) -> DataFrame:
    """``id, source, theme`` per canonical label, plus one ``extra`` row for articles having any."""
    themes = F.array_intersect(as_array(articles, "themes_mistral"), label_array(labels))
    each = articles.select("id", "source", themes.alias("themes"))
    found = F.col("themes")
    if extra is not None:
        found = F.when(F.size("themes") > 0, F.array_append("themes", F.lit(extra)))
    return each.select("id", "source", F.explode(found).alias("theme"))


def stratified_sample(
    articles: DataFrame, labels: Sequence[str] = LABELS, target: int = SAMPLE_TARGET
) -> DataFrame:
    """Articles picked round-robin over the sources of each label, up to ``ceil(target / labels)`` each.

    Both rank filters run before their shuffle as well, so a hot label or source sends each task's
    first few rows only.
    """
    quota = ceil(target / len(labels))
    in_source = F.row_number().over(Window.partitionBy("theme", "source").orderBy("id"))
    ranked = _by_label(articles, labels).withColumn("r1", in_source).where(F.col("r1") <= quota)
    in_theme = F.row_number().over(Window.partitionBy("theme").orderBy("r1", "id"))
    picked = ranked.withColumn("r2", in_theme).where(F.col("r2") <= quota).select("id").distinct()
    return articles.join(picked, "id", "left_semi")


def greedy_sample(articles: DataFrame, labels: Sequence[str] = LABELS, target: int = SAMPLE_TARGET) -> DataFrame:
    """The sequential rule, exactly: label by label, then over all, the least-used source's lowest id.

    Within a stratum the turns are a merge of the sources' sorted ids: the k-th turn of a source comes
    at its uses so far plus k, ties by id, and these keys grow along each source. So the turns taken
    are the lowest keys of the stratum, which windows and a top-k find in parallel. From one stratum to
    the next go the ids taken, ``target`` at most, and with them the uses per source. Ids are unique.
    """
    spark = articles.sparkSession
    strata = [*labels, _ALL]
    path = work_dir(spark, "sample-heads")
    _reachable(articles, labels, target).write.partitionBy("stratum").parquet(path)
    heads = spark.read.schema("id long, source string, stratum int").parquet(path)
    quotas = [ceil(target / len(labels))] * len(labels) + [target]
    taken: list[tuple] = []
    for stratum, quota in zip(range(len(strata)), quotas, strict=True):
        most = min(quota, target - len(taken))
        if most > 0:
            turns = _next_turns(heads.where(F.col("stratum") == stratum), spark.createDataFrame(taken, "id long, source string"), most)
            taken += [(r["id"], r["source"]) for r in turns.collect()]
    picked = spark.createDataFrame([(i,) for i, _ in taken], "id long")
    return articles.join(F.broadcast(picked), "id", "left_semi")


#: Stands for the stratum of all labelled articles.
_ALL = ""


def _next_turns(heads: DataFrame, taken: DataFrame, most: int) -> DataFrame:
    """The next ``most`` turns over the articles of a stratum, given those ``taken`` before it."""
    used = taken.groupBy(F.col("source").alias("by")).agg(F.count("*").alias("uses"))
    free = heads.join(F.broadcast(taken.select("id")), "id", "left_anti")
    turn = F.row_number().over(Window.partitionBy("source").orderBy("id"))
    ranked = free.withColumn("turn", turn).where(F.col("turn") <= most)
    keyed = ranked.join(F.broadcast(used), F.col("source").eqNullSafe(F.col("by")), "left")
    return keyed.orderBy(F.coalesce("uses", F.lit(0)) + F.col("turn"), "id").limit(most).select("id", "source")


def _reachable(articles: DataFrame, labels: Sequence[str], target: int) -> DataFrame:
    """``id, source, stratum`` that the rule may take: of a stratum's sources the ``target`` whose first id is
    lowest, and of each the first ``target`` ids, since no more are ever taken."""
    names = F.array(*[F.lit(x) for x in (*labels, _ALL)])
    rows = _by_label(articles, labels, extra=_ALL)
    strata = rows.select("id", "source", (F.array_position(names, F.col("theme")) - 1).cast("int").alias("stratum"))
    order = F.row_number().over(Window.partitionBy("stratum", "source").orderBy("id"))
    firsts = strata.withColumn("r", order).where(F.col("r") <= target)
    starts = strata.groupBy("stratum", "source").agg(F.min("id").alias("first"))
    lowest = F.row_number().over(Window.partitionBy("stratum").orderBy("first"))
    sources = starts.withColumn("s", lowest).where(F.col("s") <= target)
    # A missing source is one source, too.
    keep = sources.select(F.col("stratum").alias("t"), F.col("source").alias("o"))
    same = (F.col("stratum") == F.col("t")) & F.col("source").eqNullSafe(F.col("o"))
    return firsts.join(keep, same, "left_semi").select("id", "source", "stratum")


def sample_sheet(sample: DataFrame) -> DataFrame:
    """What the annotator sees: no predicted labels, sorted by id."""
    return sample.select("id", "titre", "resume", "source", "url").orderBy("id")
