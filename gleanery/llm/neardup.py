"""Near-duplicate documents: SimHash fingerprints of sampled shingles, linked by pigeonring, then verified.

A fingerprint of all shingles moves by some ten of its 64 bits between texts with a similarity of 0.8, far more
than an exact chain of segments can bear. So a document gets several fingerprints here, each folded from the few
five-word shingles that are smallest under an order of its own; texts that agree on them have fingerprints
within the linked distance. With ``SAMPLE`` shingles and ``SKETCHES`` orders, texts with a similarity of 0.8 are
linked with a probability of 0.96, and of 0.9 with 0.999.

Documents of a bucket (equal or linked fingerprints) are first compared with one of them; then all pairs whose ends
are not connected by that are compared, so no pair of a bucket stays unverified but where it changes no group.

They are compared by their smallest ``KEPT`` shingle hashes, which for most texts are all of them; for longer ones
these estimate the similarity, and whatever lies within ``MARGIN`` of the threshold is settled by all shingles of both.
They are joined at a similarity (Jaccard, over sets of shingles) of at least ``SIMILARITY``. Of each connected
group the document with the smallest id stays. Equal word sequences are one document from the start.

Defined results: NULL and blank texts are copies of one another; fewer words than a shingle are one shingle; rows
with a NULL id are never compared and stay; rows that repeat an id are one document and stay or go together;
extra columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, texts_of, tidy, with_output
from .components import components
from .simhash import _forest, fold, links, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 8
SAMPLE = 5
KEPT = 1024
#: Pairs whose similarity is estimated to within this of the threshold are settled by all their shingles. The
#: estimate's standard deviation is 0.0125 at 0.8, an eighth of it.
MARGIN = 0.1
_ROWS = 1 << 18
#: Documents of a bucket that are compared with one another in a group; larger buckets are worked on by pairs of blocks.
BLOCK = 512
#: Ids that are broadcast after they were counted (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
_ORDERS = np.random.default_rng(97).integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _digest(text: str) -> bytes:
    return xxhash.xxh128_digest(b" ".join(text.encode().lower().split()))


def describe(text: str) -> tuple[bytes, int, list[int], bytes]:
    """Digest of the word sequence, number of distinct shingles, sampled fingerprints, smallest shingle hashes."""
    digest = _digest(text)
    hashes = np.unique(shingle_hashes(text, WORDS))
    prints = []
    for order in _ORDERS if len(hashes) else []:
        mixed = hashes * order
        mixed ^= mixed >> np.uint64(31)
        mixed *= order
        least = np.argpartition(mixed, SAMPLE - 1)[:SAMPLE] if len(hashes) > SAMPLE else slice(None)
        prints.append(fold(hashes[least]))
    kept = (hashes[:KEPT] >> np.uint64(32)).astype("<u4").tobytes()
    return digest, len(hashes), prints or [0] * SKETCHES, kept


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity from the smallest shingle hashes of two documents; exact if both keep all of theirs."""
    x, y = (np.unique(np.frombuffer(s, dtype="<u4")) for s in (a, b))
    both = np.union1d(x, y)
    if not len(both):
        return 1.0
    if len(a) == 4 * KEPT or len(b) == 4 * KEPT:
        both = both[:KEPT]
    return float(np.isin(both, x, assume_unique=True).__and__(np.isin(both, y, assume_unique=True)).mean())


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).where("doc_id IS NOT NULL")
    fields = [("doc_id", pa.int64()), ("words", pa.binary()), ("n", pa.int64()), ("prints", pa.list_(pa.int64())), ("kept", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns = list(zip(*(describe(t.as_py()) for t in texts_of(part)), strict=True)) or [()] * 4
                yield with_output(fields, [part.column(0), *map(list, columns)])
            tidy()

    return rows.mapInArrow(run, "doc_id long, words binary, n long, prints array<long>, kept binary")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def buckets(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """(bucket, doc_id): the documents that share a fingerprint in a space, or that a chain of links connects there.

    ``prints`` has (doc_id, prints). Only buckets of two documents at least are kept.
    """
    node = lambda fp: F.xxhash64("space", fp)
    flat = prints.select("doc_id", F.posexplode("prints").alias("space", "fp"))
    nodes = materialize(flat.select("space", "fp").distinct(), spark, "nodes")
    edges = links(spark, nodes).select(node("a").alias("a"), node("b").alias("b"))
    chained = components(spark, edges).select(F.col("node").alias("own"), "root")
    named = flat.select("doc_id", node("fp").alias("own")).join(_sized(chained), "own", "left")
    named = materialize(named.select(F.coalesce("root", "own").alias("bucket"), "doc_id").distinct(), spark, "buckets")
    shared = named.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    return materialize(named.join(shared, "bucket").select("bucket", "doc_id", "members"), spark, "shared")


def headed(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of every bucket's documents with one of them, which a hash sets."""
    first = F.struct(F.xxhash64("doc_id", "bucket").alias("order"), "doc_id")
    heads = members.groupBy("bucket").agg(F.min(first).alias("first")).select("bucket", F.col("first.doc_id").alias("head"))
    pairs = members.join(heads, "bucket").where("doc_id <> head")
    return pairs.select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b")).distinct()


def verified(pairs: DataFrame, kept: DataFrame, least: float) -> DataFrame:
    rows = pairs.join(kept.select(F.col("doc_id").alias("a"), F.col("kept").alias("kept_a")), "a")
    rows = rows.join(kept.select(F.col("doc_id").alias("b"), F.col("kept").alias("kept_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = np.array([similarity(p, q) for p, q in zip(x, y, strict=True)], dtype=np.float64)
            sketch = np.array([len(p) == 4 * KEPT or len(q) == 4 * KEPT for p, q in zip(x, y, strict=True)], dtype=bool)
            sure = found >= np.where(sketch, least + MARGIN, least)
            use = pa.array(sure | sketch & (found >= least - MARGIN))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sure)], names=["a", "b", "sure"]).filter(use)
            tidy()

    return rows.select("a", "b", "kept_a", "kept_b").mapInArrow(run, "a long, b long, sure boolean")


def settled(spark: SparkSession, found: DataFrame, docs: DataFrame, kept: DataFrame, least: float, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of ``found`` that are sure, and those of the others whose full shingle sets are alike."""
    sure = found.where("sure").select("a", "b")
    open_ = materialize(found.where("NOT sure").select("a", "b").distinct(), spark, "open")
    if not open_.limit(1).count():
        return sure
    ids = open_.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    asked = materialize(kept.join(_sized(ids), "doc_id", "left_semi").select("doc_id", "words", "n"), spark, "asked")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    rows = rows.join(_sized(asked.select("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.int64()), ("words", pa.binary()), ("shingle", pa.int64())]
        for batch in batches:
            for one, value in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                hashes = np.unique(shingle_hashes(value.as_py(), WORDS)).view(np.int64)
                digest = _digest(value.as_py())
                for k in range(0, len(hashes), _ROWS):
                    part = hashes[k : k + _ROWS]
                    yield with_output(fields, [np.full(len(part), one), [digest] * len(part), part])
            tidy()

    shingles = rows.mapInArrow(run, "doc_id long, words binary, shingle long")
    shingles = shingles.join(_sized(asked.select("doc_id", "words")), ["doc_id", "words"], "left_semi")
    shingles = materialize(shingles.select("doc_id", "shingle").distinct(), spark, "shingles")
    both = open_.join(shingles.withColumnRenamed("doc_id", "a"), "a").join(shingles.withColumnRenamed("doc_id", "b"), ["b", "shingle"])
    counts = both.groupBy("a", "b").agg(F.count("*").alias("common"))
    for side in ("a", "b"):
        counts = counts.join(asked.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}")), side)
    exact = counts.where(F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")) >= least)
    return sure.unionByName(exact.select("a", "b"))


def estimates(kept: list[bytes], roots: np.ndarray, first: np.ndarray, second: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, places and whether they are surely alike, for every pair of ``first`` and ``second`` with different roots.

    Pairs surely below ``least`` are left out; a pair that lies in both lists comes once.
    """
    sets = [np.unique(np.frombuffer(k, dtype="<u4")) for k in kept]
    sizes = np.array([len(s) for s in sets])
    cut = np.array([len(k) == 4 * KEPT for k in kept])
    vocabulary, flat = np.unique(np.concatenate([sets[j] for j in second]), return_inverse=True)
    ends = np.cumsum(sizes[second])
    starts = ends - sizes[second]
    mark = np.zeros(len(vocabulary), dtype=bool)
    twice = set(first.tolist()) & set(second.tolist())
    for i in first.tolist():
        at = np.searchsorted(vocabulary, sets[i])
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == sets[i][known]
        mark[:] = False
        mark[at[known]] = True
        sums = np.concatenate(([0], np.cumsum(mark[flat])))
        common = sums[ends] - sums[starts]
        use = (roots[second] != roots[i]) & ((second > i) if i in twice else True)
        share = common / np.maximum(1, sizes[second] + sizes[i] - common)
        sketch = cut[second] | cut[i]
        low = np.where(sketch, least - MARGIN, least)
        use &= np.where(sketch, common / KEPT, share) >= low
        for k in np.flatnonzero(use & sketch):
            share[k] = similarity(kept[i], kept[second[k]])
        use &= share >= low
        if use.any():
            yield i, second[use], (~sketch | (share >= least + MARGIN))[use]


def met(members: DataFrame, kept: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, sure) that connect what the buckets' documents connect beyond their ``roots`` (doc_id, root).

    Every document of a bucket meets every other of another root: a bucket is cut into blocks of some ``BLOCK``
    documents by hash, and every two blocks are compared in a group of their own.
    """
    rows = members.join(roots.select("doc_id", "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.join(mixed.select("bucket"), "bucket", "left_semi")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "root")
    rows = rows.join(kept.select("doc_id", "kept"), "doc_id")

    def run(group: pa.Table) -> pa.Table:
        ids, roots = (np.asarray(group.column(c).combine_chunks()) for c in ("doc_id", "root"))
        block, i, j = (np.asarray(group.column(c).combine_chunks()) for c in ("block", "i", "j"))
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b, sure = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=bool)]
        if len(first) and len(second):
            for place, others, certain in estimates(group.column("kept").to_pylist(), roots, first, second, least):
                a.append(np.full(len(others), place))
                b.append(others)
                sure.append(certain)
        a, b, sure = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
        label = _forest(a[sure], b[sure], len(ids))
        hung = np.flatnonzero(label != np.arange(len(ids)))
        rest = np.flatnonzero(~sure & (label[a] != label[b]))
        x, y = np.concatenate((ids[hung], ids[a[rest]])), np.concatenate((ids[label[hung]], ids[b[rest]]))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "sure": np.arange(len(x)) < len(hung)})

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long, sure boolean")


def groups(spark: SparkSession, docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``root`` (smallest id of its group) of every document that is not its group's root."""
    table = materialize(described(docs, key, text), spark, "described")
    equal = table.groupBy("words").agg(F.min("doc_id").alias("root"))
    equal = materialize(table.select("doc_id", "words").join(equal, "words").select("doc_id", "root").distinct(), spark, "equal")
    heads = equal.where("doc_id = root").select("doc_id")
    prints = table.select("doc_id", "prints").join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    members = buckets(spark, prints)
    ids = members.select("doc_id").distinct()
    kept = table.select("doc_id", "words", "n", "kept").join(_sized(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    kept = materialize(kept, spark, "compared")
    first = materialize(verified(headed(members), kept, least), spark, "first")
    sure = materialize(settled(spark, first, docs, kept, least, key, text), spark, "sure")
    joined = components(spark, sure)
    more = materialize(met(members, kept, joined.select(F.col("node").alias("doc_id"), "root"), least), spark, "met")
    joined = components(spark, sure.unionByName(settled(spark, more, docs, kept, least, key, text)))
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    found = equal.join(joined, "root", "left").select("doc_id", F.coalesce("higher", "root").alias("root"))
    return materialize(found.where("doc_id <> root").distinct(), spark, "groups")


def one_of_each(spark: SparkSession, docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that repeat another with a smaller id, directly or over others."""
    gone = groups(spark, docs, least, key, text).select(F.col("doc_id").alias("_repeated_id"))
    return docs.join(_sized(gone), docs[key] == F.col("_repeated_id"), "left_anti")
