"""Phrase index against SQL and against brute force on odd tables."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from gleanery.llm import decontam
from gleanery.llm.queries import OP10_SQL, QUERIES

from ..oracle import connect, difference, spark_rows, sql_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    doc, hit, named = words(text), set(), set()
    for item, body in items:
        w = words(body)
        size = min(10, len(w))
        for s in range(len(w) - size + 1) if size else ():
            for at in range(len(doc) - size + 1):
                if doc[at : at + size] == w[s : s + size]:
                    hit.update(range(at, at + size))
                    named.add(item)
    listed = sorted(str(i) for i in named if i is not None)
    return len(doc), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, term long, cls int, words string")


def test_odd_tables(spark, make_docs):
    rng = random.Random(4)
    speak = lambda n, of="abcdefg": " ".join(rng.choice(of) for _ in range(n))
    items = [(i, speak(25)) for i in range(6)] + [(10, "One two-three"), (11, ""), (12, None), (13, "é"), (None, speak(12)), (2, "zz yy")]
    items += [(20, items[0][1]), (3, items[3][1])]
    texts = [None, "", "!!", "one TWO three", "É é", speak(4000), speak(30, "a"), items[0][1] + "x", "x " + items[0][1].upper() * 2, items[4][1][4:]]
    texts += [items[1][1] + ". " + items[2][1], "zz yy"] * 2
    docs = make_docs(*texts, ids=[*range(len(texts) - 2), None, 0])
    found = decontam.contamination(spark, docs, bench(spark, [(*i, 1, 2, "w") for i in items]))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()), key=str)
    assert got == sorted(((d.doc_id, *brute(d.text, items)) for d in docs.collect()), key=str)
    left = decontam.remove_contaminated(spark, docs, bench(spark, [(*i, 1, 2, "w") for i in items]))
    assert left.columns == docs.columns
    clean = [(d.doc_id, d.text) for d in docs.collect() if not brute(d.text, items)[4]]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(clean, key=str)


def test_empty_sides(spark, make_docs):
    docs, items = make_docs("a b", "c"), bench(spark, [(1, "a b", 1, 1, "")])
    assert decontam.contamination(spark, docs.limit(0), items).collect() == []
    rows = decontam.contamination(spark, docs, items.limit(0)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in rows) == [(0, 2, 0, False), (1, 1, 0, False)]


def test_sides_joined_by_shuffle(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    items = [(1, "the quick brown fox jumps over the lazy dog again and again")]
    docs = make_docs("see the quick brown fox jumps over the lazy dog again and so", "the quick brown fox")
    rows = decontam.contamination(spark, docs, bench(spark, [(*i, 1, 1, "") for i in items])).collect()
    assert sorted((r.doc_id, r.n_hit) for r in rows) == [(0, 11), (1, 0)]


def test_near_phrases(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = make_docs(
        item,
        "alpha beta gamma or delta epsilon zeta eta theta iota kappa",  # one word put in
        "alpha beta gamma delta epsilon zeta eta theta nothing else",  # two words lost
        "alpha beta nothing here zeta eta",
        "kappa iota theta eta zeta epsilon delta gamma beta alpha",
    )
    index = decontam.PhraseIndex(spark, docs, bench(spark, [(1, item, 0, 0, "")]))
    ids = {r.did: r.doc_id for r in index.documents().collect()}
    near = {ids[r.did] for r in index.near_phrases(slop=1, min_words=8).collect()}
    assert near == {0, 1, 2}
    assert {ids[r.did] for r in index.phrases().collect()} == {0}


def test_native_plan(spark, make_docs):
    index = decontam.PhraseIndex(spark, make_docs("a b"), bench(spark, [(1, "a b", 0, 0, "")]))
    plan = index.phrases()._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    got = spark_rows(QUERIES["op10_decontamination"](spark, folder))
    assert difference(got, sql_rows(connect(folder), OP10_SQL)) is None
