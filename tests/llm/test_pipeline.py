"""The near-duplicate stage and the whole pipeline against plain versions."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from gleanery.llm import bpe, neardup
from gleanery.llm.queries import QUERIES

from .test_decontam import brute as contamination
from .test_linededup import plain as plain_lines
from .test_simhash import plain_components

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_similarity_is_jaccard():
    rng = random.Random(2)
    base = [str(rng.randrange(50)) for _ in range(150)]
    for changes in (0, 2, 10, 60):
        other = list(base)
        for k in rng.sample(range(150), changes):
            other[k] = "x"
        a, b = " ".join(base), " ".join(other)
        assert abs(neardup.similarity(neardup.describe(a)[3], neardup.describe(b)[3]) - alike(a, b)) < 1e-9


def test_near_copies_go_and_others_stay(spark, make_docs):
    rng = random.Random(9)
    texts, near = [], {}
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        first = len(texts)
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for k in rng.sample(range(len(base)), len(base) // 60):
                other[k] = f"v{rng.randrange(5000)}"
            near[len(texts)] = first
            texts.append(" ".join(other))
        texts.append(" ".join(base[: len(base) // 2] + [f"u{rng.randrange(5000)}" for _ in range(len(base) // 2)]))
    kept = {r.doc_id for r in neardup.one_of_each(spark, make_docs(*texts)).collect()}
    close = {k for k, first in near.items() if alike(texts[k], texts[first]) >= 0.85}
    assert len(close) > 40 and len(kept & close) <= 0.03 * len(close)
    groups = plain_components(list(range(len(texts))), [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) >= 0.8])
    assert {i for i, root in groups.items() if root == i} <= kept


def test_near_duplicates_of_odd_tables(spark, make_docs):
    docs = make_docs(None, " ", "", "One two", "one TWO", "b c d", "same id", "same id", "n u l l", "n u l l", ids=[9, 8, 7, 5, 6, 4, 3, 3, None, None])
    rows = neardup.one_of_each(spark, docs)
    assert rows.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in rows.collect()) == [(0, "n u l l"), (0, "n u l l"), (3, "same id"), (3, "same id"), (4, "b c d"), (5, "One two"), (7, "")]
    assert neardup.one_of_each(spark, docs.limit(0)).collect() == []


def test_crowded_fingerprints(spark, make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    texts = ["all the same words here"] * 30 + ["another text of five words"] * 20
    assert sorted(r.doc_id for r in neardup.one_of_each(spark, make_docs(*texts)).collect()) == [0, 30]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    pred = {r.doc_id for r in QUERIES["op3_language_id"](spark, FOLDER).collect()}
    assert len(pred) == len(docs)
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language id"](spark, given, FOLDER)
    assert known.columns == given.columns and known.count() > 0.97 * len(docs)
    lined = stage["line dedup"](spark, given, FOLDER)
    assert lined.columns == given.columns
    want = {k: t for k, t, _, _ in plain_lines([(d.doc_id, d.text, d.source) for d in docs], 0.1, 5)}
    assert {r.doc_id: (r.text, r.n_chars) for r in lined.collect()} == {k: (t, None if t is None else len(t)) for k, t in want.items()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = stage["decontamination"](spark, given, FOLDER)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d.doc_id for d in docs if not contamination(d.text, items)[4])
    once = stage["near-duplicates"](spark, given, FOLDER)
    exact = {}
    for d in docs:
        exact.setdefault(tuple(d.text.lower().split()), []).append(d.doc_id)
    kept = {r.doc_id for r in once.collect()}
    assert all(len(kept & set(ids)) <= 1 for ids in exact.values())
    groups = plain_components([d.doc_id for d in docs], [(a.doc_id, b.doc_id) for a in docs for b in docs if a.doc_id < b.doc_id and alike(a.text, b.text) >= 0.8])
    assert {k for k, root in groups.items() if root == k} <= kept


def test_run_applies_all_stages(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.count() <= before.count() and docs.columns == before.columns, name
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys() and len(rows) < 200
    assert all(rows[k].ids == library.encode_ordinary(t) and rows[k].n_tokens == len(rows[k].ids) for k, t in texts.items())


@pytest.mark.parametrize(("copies", "block"), [(1000, neardup.BLOCK), (150, 40)])
def test_a_text_and_its_copies_are_joined_over_the_text(spark, make_docs, monkeypatch, copies, block):
    """Copies with edits of their own: alike to the text, not to one another."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base)]
    for i in range(copies):
        other = list(base)
        for k in rng.sample(range(5, 195), 3):
            other[k] = f"v{i}_{k}"
        texts.append(" ".join(other))
    assert all(alike(t, texts[0]) >= 0.8 for t in texts)
    sample = rng.sample(range(1, copies + 1), 100)
    assert sum(alike(texts[i], texts[j]) >= 0.8 for i in sample for j in sample if i < j) < 100
    kept = {r.doc_id for r in neardup.one_of_each(spark, make_docs(*texts)).collect()}
    assert 0 in kept and len(kept) <= 0.03 * copies


def test_long_texts_at_the_threshold(spark, make_docs):
    """3,000 words: 66 edits leave a similarity of 0.802, 67 leave 0.799; sketches cannot tell them apart."""
    rng = random.Random(8)
    texts = []
    for i in range(24):
        base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        other = list(base)
        for k in rng.sample(range(20, 2980, 40), 66 + i % 2):
            other[k] = f"v{k}"
        texts += [" ".join(base), " ".join(other)]
    assert all((alike(texts[2 * i], texts[2 * i + 1]) >= 0.8) == (i % 2 == 0) for i in range(24))
    kept = {r.doc_id for r in neardup.one_of_each(spark, make_docs(*texts)).collect()}
    assert set(range(0, 48, 2)) <= kept
    assert all(2 * i + 1 in kept for i in range(1, 24, 2))
    assert sum(2 * i + 1 in kept for i in range(0, 24, 2)) <= 3


def test_long_copies_over_a_text(spark, make_docs):
    """Long copies of one text, alike to it by little and not to one another, are settled in their blocks."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    texts = [" ".join(base)]
    for i in range(40):
        other = list(base)
        for k in rng.sample(range(20, 1480, 15), 32):
            other[k] = f"v{i}_{k}"
        texts.append(" ".join(other))
    assert all(alike(t, texts[0]) >= 0.8 for t in texts)
    kept = {r.doc_id for r in neardup.one_of_each(spark, make_docs(*texts)).collect()}
    assert 0 in kept and len(kept) <= 5
