"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonring filtering.

A fingerprint's 64 bits are a ring of segments. If two fingerprints differ in at most t bits, then from some
segment on every chain of l consecutive segments differs in at most l * t / m bits. The longest chain whose
budget is below one bit must agree exactly: it is the bucket key. Pairs in a bucket must keep the budgets of all
longer chains from there before their Hamming distance is taken.

Buckets are worked by tasks in sorted runs. What leaves a task is a forest of its links, never all pairs. The
fingerprints of a bucket beyond ``BUCKET`` are linked through the fingerprints at distance one of them instead:
two of them within two bits share such a neighbour, which has 65 in its own reach at most.

Defined results: a NULL or blank text has fingerprint zero and is linked like any other; repeated rows have one
fingerprint and one component; a component with no doc_id has a NULL id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, texts_of, with_output
from .components import components

SEED = 42
#: Segments of the ring.
SEGMENTS = 5
#: Bits by which linked fingerprints may differ.
MAX_BITS = 2
#: Distinct fingerprints of a bucket that are compared with one another; more go by their common neighbours.
BUCKET = 4096
#: Links held in a task before they are reduced to a forest.
_LINKS = 1 << 21
_HASHES = 1 << 20
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; fewer words are one run, no word none."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = memoryview(b" ".join(found))
    take = min(words, len(found))
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - take + 1].tolist()
    digest = xxhash.xxh64_intdigest
    runs = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[take - 1 :].tolist(), strict=True)]
    return np.array(runs, dtype=np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is set if it is set in over half of the hashes."""
    if len(hashes) < 64:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.int64)[0])
    counts = np.zeros((8, 8), dtype=np.int64)
    for k in range(0, len(hashes), _HASHES):
        octets = hashes[k : k + _HASHES].view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[i] += np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS
    bits = np.packbits((counts.reshape(-1) * 2 > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (64 bits as a long) of every whole text."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [fold(shingle_hashes(t.as_py(), words)) for t in texts_of(part)]
                yield with_output([("doc_id", None), ("fp", pa.int64())], [part.column(0), found])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, fp long")


def _widths(segments: int) -> list[int]:
    return [64 // segments + (i < 64 % segments) for i in range(segments)]


def _masks(segments: int) -> list[int]:
    masks, at = [], 0
    for width in _widths(segments):
        masks.append(((1 << width) - 1) << at)
        at += width
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _chain_budgets(segments: int, max_bits: int) -> tuple[int, list[int]]:
    """Length of the exact chain, and the bits allowed in chains of 1, 2, ... segments."""
    allowed = [length * max_bits // segments for length in range(1, segments + 1)]
    exact = sum(a == 0 for a in allowed)
    if not exact:
        raise ValueError("more segments than bits are needed")
    return exact, allowed


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place connected with it."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def link_runs(group: np.ndarray, start: np.ndarray, fp: np.ndarray, segments: int, max_bits: int) -> np.ndarray:
    """For rows sorted by bucket (``group`` numbers the buckets): the place each row is hung on."""
    n = len(fp)
    masks = np.array(_masks(segments), dtype=np.uint64)
    exact, allowed = _chain_budgets(segments, max_bits)
    value = fp.view(np.uint64)
    held_a, held_b, held = [], [], 0
    label = np.arange(n)
    left = np.arange(n)
    step = 0
    while True:
        step += 1
        left = left[left + step < n]
        left = left[group[left] == group[left + step]]
        if not len(left):
            break
        differ = value[left] ^ value[left + step]
        keep = np.ones(len(left), dtype=bool)
        ring = start[left]
        bits = np.zeros(len(left), dtype=np.int64)
        for length in range(exact + 1, segments + 1):
            bits += np.bitwise_count(differ & masks[(ring + length - 1) % segments])
            keep &= bits <= allowed[length - 1]
        keep &= np.bitwise_count(differ) <= max_bits
        at = left[keep]
        held_a.append(at)
        held_b.append(at + step)
        held += len(at)
        if held > _LINKS:
            label = _forest(np.concatenate([np.arange(n), *held_a]), np.concatenate([label, *held_b]), n)
            held_a, held_b, held = [], [], 0
    if held:
        label = _forest(np.concatenate([np.arange(n), *held_a]), np.concatenate([label, *held_b]), n)
    return label


def links(
    spark: SparkSession, nodes: DataFrame, segments: int = SEGMENTS, max_bits: int = MAX_BITS, bucket: int = BUCKET
) -> DataFrame:
    """Edges (space, a, b) that connect just the fingerprints which a chain of links connects.

    ``nodes`` has distinct (space, fp); fingerprints of different spaces are never linked.
    """
    if not 0 < max_bits <= 2:
        raise ValueError("fingerprints are linked at 1 or 2 bits")
    exact, _ = _chain_budgets(segments, max_bits)
    masks = _masks(segments)
    keys = [sum(masks[(i + k) % segments] for k in range(exact)) for i in range(segments)]
    chains = F.array(*[
        F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(k)).cast("long")).alias("chain"))
        for i, k in enumerate(keys)
    ])
    keyed = nodes.select("space", "fp", F.explode(chains).alias("k")).select("space", "k.start", "k.chain", "fp")
    hot = keyed.groupBy("space", "start", "chain").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    hot = materialize(hot.drop("n"), spark, "hot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
            space, start, chain, _ = columns
            fresh = np.concatenate(([True], (space[1:] != space[:-1]) | (start[1:] != start[:-1]) | (chain[1:] != chain[:-1])))
            cut = int(np.flatnonzero(fresh)[-1]) if len(fresh) else 0
            rest = [c[cut:] for c in columns]
            if cut:
                yield _hung([c[:cut] for c in columns], fresh[:cut])
        if rest is not None and len(rest[0]):
            fresh = np.zeros(len(rest[0]), dtype=bool)
            fresh[0] = True
            yield _hung(rest, fresh)

    def _hung(columns, fresh):
        space, start, _, fp = columns
        label = link_runs(np.cumsum(fresh), start, fp, segments, max_bits)
        at = np.flatnonzero(label != np.arange(len(label)))
        return with_output([("space", pa.int32()), ("a", pa.int64()), ("b", pa.int64())], [space[at], fp[at], fp[label[at]]])

    cool = keyed
    crowded = hot.limit(1).count() > 0
    if crowded:
        cool = keyed.join(hot, ["space", "start", "chain"], "left_anti")
    sorted_ = cool.repartition("space", "start", "chain").sortWithinPartitions("space", "start", "chain", "fp")
    edges = sorted_.select("space", "start", "chain", "fp").mapInArrow(run, "space int, a long, b long")
    if crowded:
        dense = keyed.join(hot, ["space", "start", "chain"], "left_semi").select("space", "fp").distinct()
        flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)).cast("long") for b in range(64)])
        near = dense.select("space", "fp", F.explode(flips).alias("flip"))
        near = near.select("space", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("via"))
        roots = near.groupBy("space", "via").agg(F.min("fp").alias("root"))
        hung = near.join(roots, ["space", "via"]).where("fp <> root")
        edges = edges.unionByName(hung.select("space", F.col("fp").alias("a"), F.col("root").alias("b")).distinct())
    return edges


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (smallest doc_id reachable over links) of every document."""
    found = materialize(fingerprints(docs, words), spark, "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("doc")).select(F.lit(0).alias("space"), "fp", "doc")
    nodes = materialize(nodes, spark, "nodes")
    edges = links(spark, nodes.select("space", "fp"), max_bits=max_bits)
    joined = components(spark, edges.select("a", "b"))
    rooted = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")
