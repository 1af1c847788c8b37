"""Tag pairs and samples against brute force."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations
from math import ceil

import pytest

from gleanery.operators import cooccurrence, sampling
from gleanery.session import work_dir

from .conftest import as_tuples


def brute_pairs(rows, min_support, top):
    items = {}
    for i, tag in rows:
        if tag is not None:
            items.setdefault(i, set()).add(tag)
    counts = Counter(p for tags in items.values() for p in combinations(sorted(tags), 2))
    kept = [(a, b, n) for (a, b), n in counts.items() if n >= min_support]
    return sorted(kept, key=lambda r: (-r[2], r[0], r[1]))[:top]


def random_rows(seed, items=60, vocabulary=30):
    rng = random.Random(seed)
    rows = []
    for i in range(items):
        for _ in range(rng.randrange(8)):
            rows.append((i, f"t{int(vocabulary * rng.random() ** 2):02d}"))
    # One item holds a third of all rows.
    rows += [(999, f"t{rng.randrange(vocabulary):02d}") for _ in range(len(rows) // 2)]
    return [*rows, (1, None)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("min_support", "top"), [(1, 10), (3, 50), (2, 7), (5, None)])
@pytest.mark.parametrize("chunk", [4, 256])
def test_pairs(spark, monkeypatch, seed, min_support, top, chunk):
    monkeypatch.setattr(cooccurrence, "CHUNK", chunk)
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "id int, tag string")
    got = as_tuples(cooccurrence.tag_cooccurrence(df, min_support, top))
    assert sorted(got, key=lambda r: (-r[2], r[0], r[1])) == brute_pairs(rows, min_support, top)


def test_pair_plan_reads_its_rows_twice(spark):
    """Once to count the tags, once for the baskets."""
    rows = spark.read.schema("id int, tag string").parquet(_stored(spark))
    plan = cooccurrence.tag_cooccurrence(rows)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def _stored(spark):
    path = work_dir(spark, "pairs")
    spark.createDataFrame(random_rows(1), "id int, tag string").write.parquet(path)
    return path


def test_pairs_are_case_sensitive(spark):
    df = spark.createDataFrame([(1, "ia"), (1, "IA"), (1, "ia")], "id int, tag string")
    assert as_tuples(cooccurrence.tag_cooccurrence(df, 1)) == [("IA", "ia", 1)]


def test_items_of_articles(make_articles):
    rows = make_articles({"tags": '["a","b","a"]'}, {"tags": "[]"}, {"tags": '["a"'})
    assert sorted(as_tuples(cooccurrence.item_tags(rows))) == [(1, "a"), (1, "a"), (1, "b")]


LABELS = ["x", "y", "z"]


def corpus(seed, n=80):
    rng = random.Random(seed)
    sources = [f"s{i}" for i in range(rng.choice([1, 3, 40]))]
    return [
        (i, rng.choice(sources), sorted({rng.choice([*LABELS, "stray"]) for _ in range(rng.randrange(3))}))
        for i in rng.sample(range(1000), n)
    ]


def brute_greedy(rows, target):
    used, taken = Counter(), []

    def pick(wanted):
        left = [r for r in rows if r[0] not in taken and wanted(r[2])]
        if not left or len(taken) >= target:
            return False
        best = min(left, key=lambda r: (used[r[1]], r[0]))
        taken.append(best[0])
        used[best[1]] += 1
        return True

    for label in LABELS:
        for _ in range(ceil(target / len(LABELS))):
            if not pick(lambda t: label in t):
                break
    while pick(lambda t: set(t) & set(LABELS)):
        pass
    return sorted(taken)


def brute_round_robin(rows, target):
    quota, picked = ceil(target / len(LABELS)), set()
    for label in LABELS:
        seen, ranked = Counter(), []
        for i, source, labels in sorted(rows):
            if label in labels:
                seen[source] += 1
                ranked.append((seen[source], i))
        picked |= {i for _, i in sorted(ranked)[:quota]}
    return sorted(picked)


def frame(spark, rows):
    import json

    return spark.createDataFrame([(i, s, json.dumps(t)) for i, s, t in rows], "id long, source string, themes_mistral string")


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("target", [7, 30])
def test_samples(spark, seed, target):
    rows = corpus(seed)
    df = frame(spark, rows)
    greedy = sorted(r["id"] for r in sampling.greedy_sample(df, LABELS, target).collect())
    assert greedy == brute_greedy(rows, target)
    spread = sorted(r["id"] for r in sampling.stratified_sample(df, LABELS, target).collect())
    assert spread == brute_round_robin(rows, target)


def test_a_large_target_runs_in_bounded_groups(spark):
    """More turns than one source has ids: the merge crosses sources, and strata end before their quota."""
    rows = [(i, f"s{i % 7}" if i % 3 else None, [LABELS[i % len(LABELS)]] if i % 4 else [LABELS[0], LABELS[1]]) for i in range(900)]
    got = sorted(r["id"] for r in sampling.greedy_sample(frame(spark, rows), LABELS, 400).collect())
    assert got == brute_greedy(rows, 400)
    everything = sampling.greedy_sample(frame(spark, rows), LABELS, 10_000)
    assert everything.count() == 900


def test_two_passes_give_the_same_pairs_and_shuffle_fewer(spark):
    from gleanery.operators import cooccurrence as c

    rng = random.Random(2)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(60)]
    rows = [(i, t) for i in range(150) for t in {rng.choice(common), rng.choice(common), *rng.sample(rare, 4)}]
    df = spark.createDataFrame(rows, "id long, tag string")
    one = c.tag_cooccurrence(df, 8, top=None)
    for buckets in (1, 64, c.BUCKETS):
        assert sorted(as_tuples(c.tag_cooccurrence(df, 8, top=None, buckets=buckets))) == sorted(as_tuples(one))
    pairs = c._pairs(c._baskets(df))
    kept = c._in_full_buckets(pairs, 8, c.BUCKETS)
    assert kept.distinct().count() == one.count() < 0.1 * pairs.distinct().count()


@pytest.mark.parametrize(("n", "range_rows"), [(1, 10), (4, 1), (4, 3), (7, 25), (3, 10_000)])
def test_ordered_windows_over_ranges(spark, n, range_rows):
    from pyspark.sql import functions as F

    from gleanery.operators.ordered import over_last_rows

    rng = random.Random(n)
    values = {at: rng.randint(0, 50) for at in rng.sample(range(10_000), 120)}
    rows = spark.createDataFrame([(f"x{at}", at, v) for at, v in values.items()], "name string, at long, v long")
    found = over_last_rows(rows, "at", n, F.sum("v"), "total", range_rows)
    assert found.columns == ["name", "at", "v", "total"]
    order = sorted(values)
    want = [(f"x{at}", at, values[at], sum(values[b] for b in order[max(0, i + 1 - n) : i + 1])) for i, at in enumerate(order)]
    assert sorted(as_tuples(found), key=lambda r: r[1]) == want
    assert over_last_rows(rows.limit(0), "at", n, F.sum("v"), "total").collect() == []
