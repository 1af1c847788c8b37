"""Radix sort against sorted(), weights and draw against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm import radix, resample
from gleanery.llm.queries import OP11_SQL, QUERIES

from ..oracle import connect, difference, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("bits, block", [(16, 1 << 19), (8, 100), (3, 64)])
def test_radix_sort(spark, bits, block):
    rng = random.Random(bits)
    ends = [0, -1, 1, -(1 << 63), (1 << 63) - 1, None] if bits == 16 else [0, -5, 7, None]
    rows = [(rng.choice([1, 1, 1, 2, -3]), rng.choice(ends) if i % 3 else rng.randint(-400, 400), i) for i in range(500)]
    table = spark.createDataFrame(rows, "a long, b long, n long").coalesce(1)
    found = radix.radix_sort(spark, table, [*radix.descending(F.col("a")), *radix.ascending(F.col("b"))], block, bits)
    got = [tuple(r)[:3] for r in sorted(found.collect(), key=lambda r: r[radix.POSITION])]
    assert sorted(r[radix.POSITION] for r in found.collect()) == list(range(500))
    # n is the order in which the rows were stored: the sort is stable.
    assert got == sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def test_radix_sort_of_little(spark):
    none = spark.createDataFrame([], "a long")
    assert radix.radix_sort(spark, none, [F.col("a")]).collect() == []
    same = spark.createDataFrame([(4,)] * 7, "a long")
    assert sorted(r[radix.POSITION] for r in radix.radix_sort(spark, same, [F.col("a")], 2).collect()) == list(range(7))
    with pytest.raises(ValueError):
        radix.radix_sort(spark, none, [F.col("a")], digit_bits=17)


def test_no_group_outgrows_a_block(spark):
    """One key on all rows: every group of a pass is a block."""
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("a"), "id")
    found = radix.radix_sort(spark, rows, [F.col("a"), F.col("id")], block=500)
    assert found.where(F.col(radix.POSITION) != F.col("id")).count() == 0


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return len(w), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for key, text in docs:
        n, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_against_plain_loops(spark, make_docs):
    rng = random.Random(9)
    speak = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "é1", "x-y", "Ünd", "42"]) for _ in range(n))
    texts = [None, "", "!", "One", *(speak(rng.randint(1, 90)) for _ in range(70)), "same text " * 15, "same text " * 15, speak(20_000)]
    ids = [*range(len(texts) - 2), None, -8]
    docs = make_docs(*texts, ids=ids)
    target = spark.createDataFrame([("alpha beta gamma", 1), (None, 1), ("x-y 42", 2)], "text string, bucket int")
    got = sorted((tuple(r) for r in resample.resample(spark, docs, target).collect()), key=str)
    assert got == brute(list(zip(ids, texts)), [r.text for r in target.collect()])


def test_empty_sides(spark, make_docs):
    docs, none = make_docs("a b " * 20, None), make_docs().select("text")
    assert resample.resample(spark, docs.limit(0), none).collect() == []
    got = sorted((tuple(r) for r in resample.resample(spark, docs, none, percent=100).collect()), key=str)
    assert [r[4] for r in got] == [1, None]


def test_query(spark):
    got = spark_rows(QUERIES["op11_resampling"](spark, FOLDER))
    assert difference(got, sql_rows(connect(FOLDER), OP11_SQL)) is None
