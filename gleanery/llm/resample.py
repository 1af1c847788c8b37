"""Importance resampling towards a target: hashed n-gram weights, and a draw without replacement by Gumbel scores.

Runs of one to ``RUNS`` words are hashed into ``BUCKETS`` buckets. Both sides are counted by bucket, map-side first,
which leaves an array of gains (floored thousandths of smoothed log ratios) of a fixed size; a document's weight is the
floored mean of the gains of its runs, looked up in that array. Adding Gumbel noise, a fixed function of document and
seed, and taking the highest sums draws without replacement in proportion to exp(weight / 1000). The ranks come from
the distributed radix sort over score and id.

Defined results: NULL and empty texts have no runs, weight 0 and are never drawn; ids are integers, a NULL one has
the noise of an empty id and comes after all others of its score; repeated rows are rows of their own, equal ids with
equal scores in the order in which they were stored; an empty target has gains that favour rare buckets; an empty table
gives no rows. Gains and weights read whole texts of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .decontam import words_of
from .hostrules import _let
from .radix import POSITION, ascending, descending, radix_sort

RUNS = 2
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1000


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``RUNS`` words."""

    def hashed(runs: Column) -> Column:
        return F.transform(runs, lambda run: F.crc32(run.cast("binary")) % buckets)

    def all_runs(w: Column) -> Column:
        found, runs = [hashed(w)], w
        for k in range(1, RUNS):
            later = F.slice(w, k + 1, F.greatest(F.size(w), F.lit(1)))
            runs = F.zip_with(runs, later, lambda a, b: F.concat(a, F.lit(" "), b))
            found.append(hashed(F.filter(runs, lambda run: run.isNotNull())))
        return F.concat(*found)

    return _let(words, all_runs)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Runs per bucket, over all rows. A map-side fold leaves at most ``buckets`` rows per task."""
    found = texts.select(F.explode(buckets_of(words_of(texts[text]), buckets)).alias("bucket")).groupBy("bucket").count()
    counts = [0] * buckets
    for row in found.collect():  # at most one row per bucket
        counts[row["bucket"]] = row["count"]
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """Floored thousandths of the log ratio of the smoothed shares of each bucket."""
    n, S, T = len(source), sum(source), sum(target)
    ratio = [float(t + 1) * float(S + n) / (float(s + 1) * float(T + n)) for s, t in zip(source, target, strict=True)]
    return [math.floor(SCALE * math.log(r)) for r in ratio]


def _noise(key: Column, seed: int) -> Column:
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(
    docs: DataFrame, gained: list[int], key: str = "doc_id", text: str = "text", seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    # A constant array, folded once per plan.
    array = F.split(F.lit(",".join(map(str, gained))), ",").cast("array<bigint>")
    zero = F.lit(0).cast("long")

    def summed(found: Column) -> Column:
        total = F.aggregate(found, zero, lambda acc, b: acc + F.get(array, b.cast("int")))
        return F.struct(F.size(found).cast("long").alias("n"), total.alias("total"))

    def told(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), _let(buckets_of(w, len(gained)), summed).alias("sum"))

    rows = docs.select(docs[key].cast("long").alias("doc_id"), _let(words_of(docs[text]), told).alias("t"))
    rows = rows.select(
        "doc_id", F.col("t.n_words").alias("n_words"), F.col("t.sum.n").alias("n_features"), F.col("t.sum.total").alias("total")
    )
    n, total = F.greatest("n_features", F.lit(1)), F.col("total")
    # Exact floor of the mean, in integers.
    weight = F.when(F.col("n_features") > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(zero)
    rows = rows.withColumn("weight", weight.cast("long"))
    return rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + _noise(F.col("doc_id"), seed)).alias("score"))


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
    percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score of every row, and rank (from 1) of those drawn: ``percent`` of the documents
    with ``min_words`` words, rounded down."""
    gained = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    rows = materialize(weigh(docs, gained, key, text, seed), spark, "weights")
    able = F.col("n_words") >= min_words
    ranked = radix_sort(spark, rows.where(able), [*descending(F.col("score")), *ascending(F.col("doc_id"))])
    drawn = percent * rows.where(able).count() // 100
    place = F.col(POSITION) + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(place <= drawn, place).alias("rank")).unionByName(
        rows.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    )
