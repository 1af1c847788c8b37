"""Source divergence against plain loops, over several tiles and slices."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import divergence
from gleanery.llm.queries import OP12_SQL, QUERIES

from ..oracle import connect, difference, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROW = "text string, lang string, source string, chunk int, term string, did int"


def brute(rows, least=10, top=10):
    documents, counts, groups = defaultdict(set), Counter(), set()
    for i, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)):
            documents[lang, term].add(i)
            counts[lang, source, term] += 1
    out = []
    for lang, source in groups:
        terms = [t for (x, t), d in documents.items() if x == lang and len(d) >= least]
        v, sources = len(terms), [s for x, s in groups if x == lang]
        share = lambda told: (lambda n: {t: 1 + 10**9 * (told(t) + 2) // (n + 2 * v) for t in terms})(sum(map(told, terms)))
        of = lambda s: share(lambda t: counts[lang, s, t])
        p, q = of(source), share(lambda t: sum(counts[lang, s, t] for s in sources))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(sum(f(p[t], of(s)[t]) for t in terms), s) for s in sources if s != source]
        words = [(f(p[t], q[t]), t) for t in terms if counts[lang, source, t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", words)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, s, x, r) for r, (x, s) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def told(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], ROW)
    return sorted(tuple(r) for r in divergence.divergence(spark, table, **more).collect())


@pytest.fixture
def rows():
    rng = random.Random(12)
    words = ["The", "the,", "THE.", "(the)", "ha-ha", "ha", "naïve", "Naïve!", "x1y2", "é", "a b", "rare,", "rare.", "Rare", "42", "odd;even"]
    found = []
    for i in range(150):
        lang, source = rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", "ß", None])
        found.append((" ".join(rng.choice(words[: rng.randint(3, 16)]) for _ in range(rng.randint(0, 12))), lang, source))
    found += [(None, "en", "s0"), ("", "fr", "s1"), ("", "fr", "s2"), ("!!", "fr", "s3"), ("solo", "it", "s0")]
    return found + [("w" * 3000 + " the\tthe\x0bthe\n" * 400, "en", "long")] + found[:5]


def test_against_plain_loops(spark, rows, monkeypatch):
    assert told(spark, rows) == brute(rows)
    # Small tiles, slices, pieces and folds give the same rows. (Workers inherit module values with the functions.)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "TERMS", 3)
    assert told(spark, rows, min_documents=3, top=2) == brute(rows, 3, 2)


def test_terms_spread_over_rare_spellings(spark):
    """Every spelling is rare; the term is in enough documents, or not, by its distinct documents only."""
    marks = ["word", "word,", "word.", "Word", "WORD;", "(word)"]
    spread = [(f"{marks[i % 6]} {marks[(i + 1) % 6]}", "en", f"s{i % 2}") for i in range(9)]
    assert all(r[2] != "term" and r[4] == 0 for r in told(spark, spread))
    assert told(spark, [*spread, ("wOrD", "en", "s0")]) == brute([*spread, ("wOrD", "en", "s0")])
    assert any(r[3] == "s1" and r[2] == "pair" for r in told(spark, [*spread, ("wOrD", "en", "s0")]))


def test_empty_table(spark):
    assert told(spark, []) == []


@pytest.mark.parametrize("run_bytes", [1, 7, 1 << 20])
def test_chunks_are_folded_over_runs(monkeypatch, run_bytes):
    """Texts longer than a run are split by pieces; all runs count documents and occurrences alike."""
    monkeypatch.setattr(divergence, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(divergence, "PIECE", 5)
    texts = ["a b a c", "a  dddddddddd e\x0ba", "", " b\t", "\n", "é\u00a0x  é\u00a0x"]
    batch = pa.record_batch([texts, [1, 1, 2, 1, 1, 1]], names=["text", "g"])
    total = Counter()
    for part in divergence._count_chunks(iter([batch, batch.slice(3, 1)])):
        for r in part.to_pylist():
            total[r["g"], r["chunk"]] += 1000 * r["occurrences"] + r["documents"]
    expected = {"a": 4002, "b": 3003, "c": 1001, "d" * 10: 1001, "e": 1001, "é\u00a0x": 2001}
    assert dict(total) == {(1, chunk): n for chunk, n in expected.items()}


def test_counts_beyond_a_long_product(spark):
    row = spark.createDataFrame([(10**13, 5 * 10**13, 1000)], "c long, n long, v long")
    assert row.select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (10**13 + 2) // (5 * 10**13 + 2000)


def test_query(spark):
    got = spark_rows(QUERIES["op12_divergence"](spark, FOLDER))
    assert difference(got, sql_rows(connect(FOLDER), OP12_SQL)) is None


def test_marked_chunks_are_found_in_whole_documents(monkeypatch):
    """The bits of some chunks let these through, in long texts too; whatever else comes through is told by the join."""
    monkeypatch.setattr(divergence, "RUN_BYTES", 40)
    asked = pa.array(["alpha", "é,", "x" * 30, "x" * 31], pa.string())
    bits = np.zeros(1 << divergence.BITS - 6, dtype=np.uint64)
    for p in divergence._places(asked):
        bits[int(p) >> 6] |= np.uint64(1) << (p & np.uint64(63))
    texts = ["alpha beta alpha", "", "é, b " + "x" * 30, "c " * 50 + "x" * 31 + " alpha", "nothing"]
    batch = pa.record_batch([texts, ["l"] * 5, [7, 8, 9, 10, 11]], names=["text", "lang", "did"])
    found = [r for part in divergence._chunks_met(bits)(iter([batch, batch.slice(2, 1)])) for r in part.to_pylist()]
    got = sorted((r["did"], r["chunk"]) for r in found if r["chunk"] in asked.to_pylist())
    assert got == sorted([(7, "alpha"), (10, "alpha"), (10, "x" * 31)] + 2 * [(9, "é,"), (9, "x" * 30)])
    assert len(found) <= len(got) + 2
