"""Hash forest: recall against brute force, exact scores, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from gleanery.llm import hashforest
from gleanery.llm.queries import QUERIES


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        scores = vectors @ vectors[ids.index(q)]
        order = sorted((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


@pytest.mark.parametrize(("folder", "least"), [("/root/testdata/sf0.001", 1.0), ("/root/testdata/sf0.1", 0.9)])
def test_query(spark, folder, least):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    want = brute(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in QUERIES["op4_hash_forest"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= least
    for q, found in got.items():
        own = vectors[ids.index(q)]
        assert all(abs(s - float(own @ vectors[ids.index(i)])) < 1e-12 for i, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


def test_recall_with_few_candidates(spark):
    """Clustered vectors, small leaves and a forest that ascends only part of the way."""
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((80, 24))
    data = np.repeat(centers, 50, axis=0) + 0.3 * rng.standard_normal((4000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    forest = hashforest.HashForest(spark, frame, k=10, trees=10, factor=2.0)
    assert forest.wanted < 0.25 * len(data)
    code = forest.strings.where("entry = 0").first().codes
    reached = forest.directory.ascend(code, forest.wanted)
    assert sum(int(forest.directory.totals[t][b] - forest.directory.totals[t][a]) for t, a, b in reached) < 0.6 * len(data)
    got = {}
    for r in forest.search(lambda i: i % 40 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    want = brute(list(range(len(data))), data, list(got), 10)
    hits = sum(len(got[q] & {i for i, _ in want[q]}) for q in want)
    assert len(got) == 100 and hits / 1000 >= 0.9


def test_crowded_prefixes_are_cut_deeper(spark, monkeypatch):
    """A tight bundle of vectors goes into deep leaves, and the strings they share into parts of a leaf."""
    rng = np.random.default_rng(2)
    data = np.concatenate((np.ones(16) + 0.02 * rng.standard_normal((900, 16)), rng.standard_normal((100, 16))))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(hashforest, "LEAF", 16)
    forest = hashforest.HashForest(spark, frame, k=5, trees=4, factor=0.5)
    found = forest.directory
    assert all(t[-1] == 1000 for t in found.totals) and max(found.depths) > 10
    for totals, parts in zip(found.totals, found.parts, strict=True):
        assert (np.diff(totals) <= 64 * parts).all()
    assert max(p.max() for p in found.parts) > 1
    got = {}
    for r in forest.search(lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    want = brute(list(range(len(data))), data, list(got), 5)
    assert len(got) == 50 and sum(len(got[q] & {i for i, _ in want[q]}) for q in want if q < 900) >= 0.9 * 45 * 5


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (20, [1.0, 0.0], "a"), (3, [1.0, 0.0], "a"), (4, [0.5, 0.5], "a"), (5, [-1.0, 0.0], "a"), (4, [0.5, 0.5], "b")]
    rows += [(6, None, "a"), (7, [0.0, 0.0], "a"), (8, [nan, 1.0], "a"), (9, [inf, 1.0], "a"), (10, [None, 1.0], "a"), (11, [1.0], "a"), (None, [1.0, 1.0], "a"), (40, [0.0, 0.0], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, entry string")
    found = hashforest.HashForest(spark, frame, k=3).search(lambda i: i % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.id, r.score) for r in found] == [
        (0, 1, 3, 1.0), (0, 2, 20, 1.0), (0, 3, 4, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 1.0), (20, 3, 4, 0.5),
    ]
    assert hashforest.HashForest(spark, frame.limit(0), k=3).search(lambda i: i == 0).collect() == []
    all_equal = spark.createDataFrame([(i, [2.0, 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    got = hashforest.HashForest(spark, all_equal, k=4).search(lambda i: i % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(q, i) for q, near in [(0, [1, 2, 3, 4]), (20, [0, 1, 2, 3]), (40, [0, 1, 2, 3])] for i in near]


def found_by(forest, queries):
    got = {}
    for r in forest.search(queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    return got


@pytest.mark.parametrize("leaf", [100, 20_000])
def test_ties_go_to_the_smaller_id(spark, monkeypatch, leaf):
    """0/1 vectors tie in crowds; a forest that reaches the whole table gives the rows of brute force."""
    rng = np.random.default_rng(5)
    data = (rng.random((1499, 12)) < 0.4).astype(float)
    ids = rng.permutation(3000)[: len(data)].tolist()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, data)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(hashforest, "LEAF", leaf)
    forest = hashforest.HashForest(spark, frame, k=20, factor=1e6)
    used = [i for i, v in zip(ids, data) if v.any()]
    want = brute(used, data[data.any(axis=1)], [i for i in used if i % 20 == 0], 20)
    assert found_by(forest, lambda i: i % 20 == 0) == want


def test_nearest_sums_in_one_order():
    rng = np.random.default_rng(6)
    stored = np.repeat(rng.standard_normal((40, 33)), 5, axis=0)[rng.permutation(200)]
    asked = rng.standard_normal((17, 33))
    exact = np.array([[(a * s).sum() for s in stored] for a in asked])
    for keep in (1, 4, 7, 199, 200, 300):
        at, score = hashforest.nearest(asked, stored, keep)
        for i in range(len(asked)):
            best = np.lexsort((np.arange(200), -exact[i]))[:keep]
            assert set(at[i].tolist()) == set(best.tolist())
            assert (score[i] == exact[i][at[i]]).all()


def test_norms_of_all_sizes(spark):
    rng = np.random.default_rng(7)
    data = rng.standard_normal((6000, 48)) * rng.lognormal(0, 1, 6000)[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = found_by(hashforest.HashForest(spark, frame, k=20), lambda i: i % 100 == 0)
    want = brute(list(range(len(data))), data, list(got), 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
