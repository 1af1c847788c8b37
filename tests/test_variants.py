"""Spellings of a tag against plain loops, chains included."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from gleanery.operators import variants

from .conftest import as_tuples


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(tags):
    table = str.maketrans(variants.ACCENTED, variants.PLAIN)
    form = lambda t: "".join(c for c in t.lower().translate(table) if c.isalnum())
    digits = lambda f: "".join(c for c in f if c.isdigit())
    counts = Counter(t for t in tags if t is not None)
    forms = {form(t) for t in counts} - {""}
    of = {f: f for f in forms}

    def root(f):
        while of[f] != f:
            f = of[f]
        return f

    for a in forms:
        for b in forms:
            if a < b and min(len(a), len(b)) >= 6 and digits(a) == digits(b) and edit(a, b) <= 1:
                of[root(b)] = root(a)
    groups = {}
    for t in counts:
        groups.setdefault(root(form(t)) if form(t) else " " + t, []).append(t)
    best = {t: min(g, key=lambda x: (-counts[x], x)) for g in groups.values() for t in g}
    return sorted((t, best[t], n) for t, n in counts.items())


def found(spark, tags):
    rows = spark.createDataFrame(list(enumerate(tags)), "id long, tag string")
    return sorted(as_tuples(variants.tag_variants(rows)))


def test_rules(spark):
    tags = ["Café-Crème", "cafe creme", "cafecreme", "cafe cremes", "ring", "rings", "version 1", "version 2", "versions 1"]
    tags += ["#!", "--", None, "", "a" * 300, "a" * 301, "cafe creme"]
    got = found(spark, tags)
    assert got == brute(tags)
    by = {t: c for t, c, _ in got}
    assert by["Café-Crème"] == by["cafe cremes"] == "cafe creme" and by["rings"] == "rings"
    assert by["version 2"] == "version 2" != by["versions 1"]
    assert found(spark, []) == []


def test_a_long_chain_is_one_group(spark):
    """Each is one letter from the next, the ends are far apart."""
    chain = ["start" + "x" * i for i in range(2, 60)]
    got = found(spark, chain)
    assert {c for _, c, _ in got} == {"startxx"} and len(got) == 58


@pytest.mark.parametrize("seed", [1, 2])
def test_random_spellings(spark, seed):
    rng = random.Random(seed)
    base = ["security", "database", "architecture", "python", "machine learning", "réseau 5g"]
    tags = []
    for _ in range(250):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(t))
            rng.choice([lambda: t.insert(at, rng.choice("aeéX 1")), lambda: t.pop(at), lambda: t.__setitem__(at, rng.choice("aeiS-"))])()
        tags.append("".join(t))
    assert found(spark, tags) == brute(tags)
