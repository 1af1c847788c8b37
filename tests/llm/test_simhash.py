"""SimHash, its links and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import simhash
from gleanery.llm.components import components
from gleanery.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


def near(values, bits):
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= bits]


TEXTS = ["", None, " \n", "One", "one TWO", "a b c", "A B C", "a\x0bb\x0cc d", "é É x y", "a b c " * 50, "x\x85y z w"]


@pytest.mark.parametrize("words", [1, 3, 5])
def test_fingerprints(spark, make_docs, words):
    rows = simhash.fingerprints(make_docs(*TEXTS), words).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in rows} == {i: plain_fingerprint(t, words) for i, t in enumerate(TEXTS)}


def test_fold_of_many_hashes_equals_plain():
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 501, dtype=np.uint64) * np.uint64(2)
    whole = simhash.fold(hashes) % (1 << 64)
    assert whole == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))


def crowd(n, seed=0):
    rng = random.Random(seed)
    found = {rng.getrandbits(64) for _ in range(n)}
    for center in list(found)[: n // 4]:
        for _ in range(6):
            found.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    return sorted(found)


@pytest.mark.parametrize(("bits", "bucket", "segments"), [(2, 4096, 5), (2, 4, 5), (1, 4096, 3), (1, 3, 5), (2, 4096, 7)])
def test_links_connect_as_brute_force(spark, bits, bucket, segments):
    values = crowd(60)
    rows = [(s, v - (1 << 64) if v >> 63 else v) for v in values for s in (0, 1)]
    nodes = spark.createDataFrame(rows, "space int, fp long")
    found = simhash.links(spark, nodes, segments=segments, max_bits=bits, bucket=bucket).collect()
    mask = (1 << 64) - 1
    want = plain_components(values, near(values, bits))
    for space in (0, 1):
        edges = [(r.a & mask, r.b & mask) for r in found if r.space == space]
        got = plain_components(values, edges)
        assert got == want


def test_a_bucket_is_not_listed_pair_by_pair(spark):
    values = sorted({1 << 63 | sum(1 << b for b in random.Random(i).sample(range(13), 2)) for i in range(300)})
    nodes = spark.createDataFrame([(0, v - (1 << 64)) for v in values], "space int, fp long")
    assert simhash.links(spark, nodes).count() <= 5 * len(values)


def test_components_of_chains_stars_and_repeats(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, k) for k in range(101, 160)]
    edges = [*chain, *star, (7, 3), (3, 7), (5, 5), (None, 4), (200, 201)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 160), 100), 201: 200}
    assert got == want
    assert components(spark, spark.createDataFrame([], "x long, y long")).collect() == []


def test_near_duplicates_of_odd_tables(spark, make_docs):
    docs = make_docs("a b c", "A b c", None, "", "x y z", "a b c", ids=[4, 2, 9, 8, None, 4])
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(spark, docs).collect())
    assert got == [(0, 0), (2, 2), (4, 2), (4, 2), (8, 8), (9, 8)]
    assert simhash.near_duplicates(spark, docs.limit(0)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    prints = {d.doc_id: plain_fingerprint(d.text, 3) for d in docs}
    of = {}
    for key, fp in prints.items():
        of[fp] = min(of.get(fp, key), key)
    groups = plain_components(list(of), near(list(of), 2))
    least = {}
    for fp, root in groups.items():
        least[root] = min(least.get(root, of[fp]), of[fp])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, folder).collect()}
    assert got == {k: (f"{fp:016x}", least[groups[fp]]) for k, fp in prints.items()}


def test_only_small_distances(spark):
    with pytest.raises(ValueError):
        simhash.links(spark, spark.range(1).select(F.lit(0).alias("space"), F.col("id").alias("fp")), max_bits=3)
