"""Line deduplication by site-relative frequency: lines on more than a share of a host's pages are boilerplate.

Lines are compared without the blanks around them, and a page counts once for each of its distinct lines. Blank
lines are never counted and never dropped. Lines are told apart by a 64-bit hash within their host.

Defined results: NULL text stays NULL and counts as a page without lines; pages with a NULL host are never
changed; a page of which no line would be left stays as it was, for then it is a copy and not a page built from
a template; repeated rows are pages of their own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Share of a host's pages above which a line is boilerplate.
RATIO = 0.1
#: Pages that must hold a line at least: on hosts with few pages a share alone says nothing.
MIN_PAGES = 5
#: Rows of the boilerplate table that are broadcast after they were counted (16 bytes each); more are shuffled.
BROADCAST_LINES = 2_000_000
_BLANKS = " \t\r"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def boilerplate(spark: SparkSession, docs: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """Stored (host, line) hashes of all boilerplate lines.

    A line above the ratio fills that share of the host's pages, so a host has at most its mean number of
    distinct lines a page, divided by the ratio.
    """
    pages = docs.select(docs[host].alias("host"), docs[text].alias("text")).where("host IS NOT NULL")
    tidy = F.btrim(F.regexp_replace("text", r"[ \t\r]*\n[ \t\r\n]*", "\n"), F.lit(_BLANKS + "\n"))
    lines = pages.select("host", F.explode(F.array_distinct(F.split(tidy, "\n"))).alias("line")).where("line <> ''")
    counts = lines.groupBy("host", _key(F.col("line")).alias("line")).agg(F.count("*").alias("pages"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    frequent = counts.where(F.col("pages") >= min_pages).join(totals, "host")
    return materialize(frequent.where(F.col("pages") > ratio * F.col("total")).select("host", "line"), spark, "boilerplate")


def remove_boilerplate(
    spark: SparkSession, docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
    min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, counts: bool = True,
) -> DataFrame:
    """All columns of ``docs`` with the kept lines as ``text``; ``n_lines`` and ``n_dropped`` follow if asked."""
    bad = boilerplate(spark, docs, host, text, ratio, min_pages)
    small = bad.limit(broadcast_lines + 1).count() <= broadcast_lines
    by_host = bad.groupBy("host").agg(F.collect_list("line").alias("_dedup_bad")).withColumnRenamed("host", "_dedup_host")
    joined = docs.join(F.broadcast(by_host) if small else by_host, docs[host] == F.col("_dedup_host"), "left")
    lines = F.split(docs[text], "\n")
    hit = F.array_intersect(F.transform(lines, _key), F.col("_dedup_bad"))
    staged = joined.withColumns({"_dedup_lines": lines, "_dedup_hit": hit})
    kept = F.filter("_dedup_lines", lambda line: ~F.array_contains(F.col("_dedup_hit"), _key(line)))
    staged = staged.withColumn("_dedup_kept", F.when(F.size("_dedup_hit") > 0, kept).otherwise(F.col("_dedup_lines")))
    left = F.exists("_dedup_kept", lambda line: F.btrim(line, F.lit(_BLANKS)) != "")
    changed = (F.size("_dedup_kept") < F.size("_dedup_lines")) & left
    columns = [F.when(changed, F.array_join("_dedup_kept", "\n")).otherwise(docs[text]).alias(text) if c == text else docs[c] for c in docs.columns]
    if not counts:
        return staged.select(*columns)
    n_lines = F.coalesce(F.size("_dedup_lines"), F.lit(0))
    return staged.select(
        *columns,
        F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(changed, F.size("_dedup_lines") - F.size("_dedup_kept")).otherwise(0).cast("long").alias("n_dropped"),
    )
