"""Benchmark decontamination over a stored positional inverted index, in DataFrame operations only.

The index holds a posting (term, did, pos) for every place in the corpus where a term of the benchmark stands,
sorted by term within its files, and one row per document with its length. A window of consecutive benchmark
words is looked up from its rarest terms: the postings of its rarest one, shifted by the term's place, are
intersected with the shifted postings of the second rarest; the alignments left are checked word by word
against the index, and runs that are long enough are the exact phrases found.

Defined results: NULL text has no words; an item shorter than a window is one window, an item without words
none; items with equal words are found together; a NULL item id marks words but is not listed; documents are
rows, so repeated rows (or NULL ids) each have a result of their own; an empty benchmark or corpus finds nothing.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 10
#: Everything that is no word character; what is left are digits, a-z and all of Unicode beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a side that is broadcast after it was counted (below 100 bytes each); beyond it, joins shuffle.
BROADCAST_ROWS = 500_000
_LENGTH = "\u0001"  # stands for a document's length in the index; no word can be it


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _sized(df: DataFrame) -> DataFrame:
    """The stored table, with a broadcast hint if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class PhraseIndex:
    """Postings of all benchmark terms in a corpus, and the benchmark's own words by term."""

    def __init__(self, spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_key="doc_id", item_key="item_id", text="text"):
        self.spark = spark
        items = benchmark.select(benchmark[item_key].alias("item_id"), words_of(benchmark[text]).alias("words"))
        items = items.where(F.size("words") > 0)
        classes = items.select("words").distinct().select(F.monotonically_increasing_id().alias("cls"), "words")
        classes = materialize(classes, spark, "classes")
        self.items = materialize(items.join(classes, "words").select("cls", "item_id").distinct(), spark, "items")
        spoken = classes.select("cls", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))
        terms = spoken.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term"))
        length = spark.createDataFrame([(_LENGTH, -1)], "word string, term long")
        self.terms = materialize(terms.unionByName(length), spark, "terms")
        self.places = materialize(spoken.join(self.terms, "word").select("cls", "n", "p", "term"), spark, "places")
        rows = docs.select(
            F.monotonically_increasing_id().alias("did"),
            docs[doc_key].alias("doc_id"),
            F.xxhash64(docs[text]).alias("text_hash"),
            words_of(docs[text]).alias("words"),
        )
        # Position 0 is the length row, so that words count from 1.
        told = F.concat(F.array(F.lit(_LENGTH)), "words")
        rows = rows.select("did", "doc_id", "text_hash", F.size("words").alias("n"), F.posexplode(told).alias("pos", "word"))
        posted = rows.join(_sized(self.terms), "word").select(
            "term",
            "did",
            F.when(F.col("term") < 0, F.col("n")).otherwise(F.col("pos")).alias("pos"),
            *[F.when(F.col("term") < 0, F.col(c)).alias(c) for c in ("doc_id", "text_hash")],
        )
        self.index = materialize(posted.sortWithinPartitions("term"), spark, "postings")
        self.postings = self.index.where("term >= 0").select("term", "did", "pos")
        counts = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        self.counts = materialize(counts, spark, "counts")
        self.pairs = materialize(self._rarest_pairs(), spark, "anchors")

    @staticmethod
    def _windows() -> Column:
        """Starts of the windows of an item that hold the place ``p``."""
        last = F.greatest(F.col("n") - WINDOW, F.lit(0))
        return F.sequence(F.greatest(F.col("p") - (WINDOW - 1), F.lit(0)), F.least("p", last))

    def _rarest(self, most: int) -> DataFrame:
        """The ``most`` rarest words of every window: cls, s (its start), p, term, df, rank."""
        inside = self.places.join(_sized(self.counts), "term", "left").na.fill({"df": 0})
        inside = inside.select("cls", "p", "term", "df", F.explode(self._windows()).alias("s"))
        rank = F.row_number().over(W.partitionBy("cls", "s").orderBy("df", "p"))
        return inside.withColumn("rank", rank).where(F.col("rank") <= most)

    def _rarest_pairs(self) -> DataFrame:
        """Per window of an item: place and term of its rarest and second rarest word."""
        inside = self._rarest(2)
        first = [F.max(F.when(F.col("rank") == 1, F.col(c))).alias(f"{c}1") for c in ("p", "term", "df")]
        second = [F.max(F.when(F.col("rank") == 2, F.col(c))).alias(f"{c}2") for c in ("p", "term")]
        found = inside.groupBy("cls", "s").agg(*first, *second).where("df1 > 0")
        return found.select("cls", "p1", "term1", "p2", "term2").distinct()

    def documents(self) -> DataFrame:
        return self.index.where("term < 0").select("did", "doc_id", "text_hash", F.col("pos").alias("n_words"))

    def _alignments(self) -> DataFrame:
        """(did, cls, delta) at which the two rarest words of a window stand in place."""
        seeds = self.postings.join(_sized(self.pairs), F.col("term") == F.col("term1"))
        seeds = seeds.select("did", "cls", (F.col("pos") - F.col("p1")).alias("delta"), "p2", "term2")
        alone = seeds.where("p2 IS NULL").select("did", "cls", "delta")
        seeds = seeds.where("p2 IS NOT NULL")
        seeds = seeds.select("did", (F.col("delta") + F.col("p2")).alias("pos"), F.col("term2").alias("term"), "cls", "delta")
        wanted = materialize(self.pairs.select(F.col("term2").alias("term")).distinct(), self.spark, "seconds")
        seconds = self.postings.join(_sized(wanted), "term", "left_semi")
        both = seeds.join(seconds, ["did", "pos", "term"]).select("did", "cls", "delta")
        return both.unionByName(alone).distinct()

    def _within(self, seeds: DataFrame) -> DataFrame:
        """Postings of the documents that still have an alignment."""
        dids = materialize(seeds.select("did").distinct(), self.spark, "candidates")
        return self.postings.join(_sized(dids), "did", "left_semi")

    def phrases(self) -> DataFrame:
        """Exact matches: did, cls, first and last word position (from 1) of every run of matching windows."""
        seeds = materialize(self._alignments(), self.spark, "alignments")
        expected = seeds.join(_sized(self.places), "cls").withColumn("pos", F.col("delta") + F.col("p"))
        matched = expected.join(self._within(seeds), ["did", "pos", "term"])
        order = F.row_number().over(W.partitionBy("did", "cls", "delta").orderBy("p"))
        runs = matched.withColumn("run", F.col("p") - order).groupBy("did", "cls", "delta", "run", "n")
        runs = runs.agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
        return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.lit(WINDOW), "n")).select("did", "cls", "first", "last")

    def near_phrases(self, slop: int = 2, min_words: int = WINDOW - 2) -> DataFrame:
        """Proximity matches: windows of an item of which at least ``min_words`` words (all of a shorter one) stand
        within ``slop`` of their place, counted from one of them: did, cls, start (in the item), at, found.

        One of a window's rarest words must be there if only so many may be missing; these give the alignments.
        """
        anchors = self._rarest(WINDOW - min_words + 1).where("df > 0").select("cls", F.col("p").alias("p1"), "term").distinct()
        anchors = materialize(anchors, self.spark, "anchors")
        seeds = self.postings.join(_sized(anchors), "term").select("did", "cls", (F.col("pos") - F.col("p1")).alias("delta"))
        seeds = materialize(seeds.distinct(), self.spark, "near")
        away = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
        expected = seeds.join(_sized(self.places), "cls").withColumn("away", away)
        expected = expected.withColumn("pos", F.col("delta") + F.col("p") + F.col("away"))
        matched = expected.join(self._within(seeds), ["did", "pos", "term"]).select("did", "cls", "delta", "p", "n").distinct()
        windows = matched.select("did", "cls", "delta", "n", F.explode(self._windows()).alias("start"))
        found = windows.groupBy("did", "cls", "delta", "start", "n").agg(F.count("*").alias("found"))
        found = found.where(F.col("found") >= F.least(F.lit(min_words), "n"))
        return found.select("did", "cls", "start", (F.col("delta") + F.col("start")).alias("at"), "found")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **keys: str) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = PhraseIndex(spark, docs, benchmark, **keys)
    found = materialize(index.phrases(), spark, "phrases")
    hit = found.select("did", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    hit = hit.groupBy("did").agg(F.count("*").alias("n_hit"))
    listed = found.select("did", "cls").distinct().join(_sized(index.items), "cls")
    listed = listed.where("item_id IS NOT NULL").select("did", F.col("item_id").cast("string").alias("item")).distinct()
    listed = listed.groupBy("did").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = index.documents().join(hit, "did", "left").join(listed, "did", "left")
    return rows.select(
        "doc_id",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    dirty = contamination(spark, docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("_dirty_id"), F.col("text_hash").alias("_dirty_hash")
    )
    dirty = materialize(dirty.distinct(), spark, "contaminated")
    same = docs["doc_id"].eqNullSafe(F.col("_dirty_id")) & (F.xxhash64(docs["text"]) == F.col("_dirty_hash"))
    return docs.join(_sized(dirty), same, "left_anti")
