"""Language and toxicity models: held-out accuracy, and what each odd text gives."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import flattext, langid, toxicity
from gleanery.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_words_and_sentences_of_flat_texts():
    texts = ["Été, x1y! Ça", "", "Nothing_else.\nhere", "ab" * 100]
    points, starts = flattext.flatten(texts)
    at, to, spelled = flattext.words(points)
    shown = ["".join(map(chr, points[a:b])).lower() for a, b in zip(at, to, strict=True)]
    assert shown == ["été", "x", "y", "ça", "nothing", "else", "here", "ab" * 100]
    again = flattext.words(flattext.flatten(["ÇA x", "AB" * 100 + " ab"])[0])[2]
    assert again[0] == spelled[3] and again[1] == spelled[1] and again[2] == spelled[7] != again[3]
    assert len(set(spelled.tolist())) == len(spelled)
    of = flattext.sentences(points)
    assert of[starts[1]] > of[starts[1] - 1] and of[starts[-1] - 1] > of[starts[0]]


def test_subwords_do_not_depend_on_neighbours():
    one = flattext.subwords(flattext.flatten(["abc"])[0], (2, 3), 1 << 16)[1]
    many = flattext.subwords(flattext.flatten(["x, abc; y"])[0], (2, 3), 1 << 16)[1]
    assert set(one.tolist()) <= set(many.tolist()) and len(one) == 4 + 3


def test_language_held_out(spark):
    rows = QUERIES["op3_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id")
    held = rows.where("held_out").select("lang", "lang_pred", "score", "rejected").collect()
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in held) and sum(r.rejected for r in held) / len(held) < 0.02


def test_language_of_odd_texts(spark, make_docs):
    rng = random.Random(0)
    say = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(30))
    texts = [say(["ba", "ko", "mi"]) for _ in range(40)] + [say(["sch", "ung", "ei"]) for _ in range(40)]
    model = langid.train(texts, ["x"] * 40 + ["y"] * 40)
    docs = make_docs(texts[0], None, "", "12 !?", "²½", texts[50] * 2000, "щжы" * 40)
    rows = {r.doc_id: r for r in langid.predict(spark, docs, model).collect()}
    assert [rows[i].lang_pred for i in range(6)] == ["x", "und", "und", "und", "und", "y"]
    assert [rows[i].lang_rejected for i in range(6)] == [False, True, True, True, True, False]
    assert rows[1].lang_score == 0 and rows[0].lang_score > 0.9
    assert set(docs.columns) < set(rows[0].asDict())
    none = langid.fit(spark, docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(spark, docs, none).collect()} == {"und"}
    assert langid.predict(spark, docs.limit(0), model).collect() == []
    parts = langid.LanguageModel(**vars(model))
    assert np.allclose(parts.logits([t for t in texts])[0][3], parts.logits([texts[3]])[0][0])


def test_calibrated_confidence_is_no_overstatement():
    rng = random.Random(1)
    mixed = lambda p: " ".join(rng.choice(["bako", "mira"] if rng.random() < p else ["schu", "ngei"]) for _ in range(6))
    texts = [mixed(0.7) for _ in range(300)] + [mixed(0.3) for _ in range(300)]
    langs = ["x"] * 300 + ["y"] * 300
    model = langid.train(texts, langs)
    fresh = [mixed(0.7) for _ in range(300)] + [mixed(0.3) for _ in range(300)]
    labels, score, _ = model.predict(fresh)
    right = np.mean([a == b for a, b in zip(labels, langs, strict=True)])
    assert abs(score.mean() - right) < 0.08


def toxic_corpus(n=600):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(8)) + "."
    texts, labels = [], []
    for i in range(n):
        body = [sentence() for _ in range(rng.randint(1, 12))]
        if i % 5 == 0:
            body[rng.randrange(len(body))] = rng.choice(["you vile alpha.", f"what gruntle{rng.choice('abcdef')}{rng.choice('xyz')} beta!"])
        texts.append(" ".join(body))
        labels.append(int(i % 5 == 0))
    return texts, labels


def test_toxic_sentences_are_found_from_document_labels():
    texts, labels = toxic_corpus()
    model = toxicity.train(texts[:400], labels[:400])
    score, _, _ = model.score(texts[400:])
    assert ((score >= 0.5) == np.array(labels[400:], dtype=bool)).all()
    for text, label in zip(texts[400:], labels[400:], strict=True):
        worst = [text[a:b] for a, b, s in model.sentences(text) if s >= 0.5]
        assert bool(worst) == bool(label) and all("vile" in w or "gruntle" in w for w in worst)
    assert model.score(["you VILE alpha " + "beta " * 5000])[0][0] > 0.5
    # New endings of a known stem, and harmless words however often.
    assert model.score(["such gruntleqq here"])[0][0] > 0.5 > model.score(["beta " * 5000])[0][0]


def test_toxicity_of_odd_tables(spark, make_docs):
    texts, labels = toxic_corpus(200)
    model = toxicity.train(texts, labels)
    docs = make_docs(None, "", "you vile alpha.", "you vile alpha.", "fine", ids=[1, 2, 3, 3, None])
    rows = toxicity.score(spark, docs, model).collect()
    scores = {(r.doc_id, r.score >= 0.5) for r in rows}
    assert len(rows) == 5 and scores == {(1, False), (2, False), (3, True), (None, False)}
    assert all(0 <= r.score <= 1 for r in rows)
    found = toxicity.offending_sentences(spark, docs, model).collect()
    assert [(r.doc_id, r.sentence) for r in found] == [(3, "you vile alpha")] * 2 or len(found) == 2
    assert toxicity.score(spark, docs.limit(0), model).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(spark, docs, toxicity.fit(spark, docs, labels)).where("score >= 0.5").count() == 0
    labels = spark.createDataFrame([(None, 1, 1), (3, 1, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(spark, docs, toxicity.fit(spark, docs, labels)).count() == 5


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_toxicity_held_out(spark, folder):
    rows = QUERIES["op1_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    held = rows.where("held_out").select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in held) / len(held)
    caught = [r.predicted for r in held if r.toxic]
    assert len(held) > 500 and right > 0.96 and sum(caught) / len(caught) > 0.75


def test_noisy_or_against_a_plain_loop():
    texts, labels = toxic_corpus(300)
    model = toxicity.train(texts, labels)
    some = [*texts[:40], "", "gamma. you vile alpha. what a vile vile beta! delta", "vile. " * 5]
    got, top, where = model.score(some)
    for i, text in enumerate(some):
        p = [s for _, _, s in model.sentences(text)] or [1 / (1 + np.exp(-model.bias))]
        counted = [s for s in p if s >= toxicity.FAINT] or [max(p)]
        assert got[i] == pytest.approx(1 - np.prod([1 - s for s in counted]))
        assert top[i] == pytest.approx(max(p)) and p[where[i]] == pytest.approx(max(p))


def test_length_is_no_evidence(spark):
    """Two million characters of clean texts that are left alone one by one, and a toxic sentence among them."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(spark, docs, labels)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    own = model.score([r.text for r in rows])[0]
    clean = "\n".join(r.text for r, s in zip(rows, own, strict=True) if not r.toxic and s < 0.5)
    assert sum(s >= 0.5 for r, s in zip(rows, own, strict=True) if not r.toxic) <= 0.002 * len(rows)
    clean = (clean * (1 + 2_000_000 // len(clean)))[:2_000_000]
    toxic = max((r.text for r in rows if r.toxic and len(r.text) < 2000), key=lambda t: model.score([t])[0][0])
    a, b, _ = max(model.sentences(toxic), key=lambda s: s[2])
    score, _, where = model.score([clean, clean[:1_000_000] + "\n" + toxic[a:b] + "\n" + clean[1_000_000:]])
    assert score[0] < 0.5 <= score[1] and where[1] > 1000


def test_fits_read_an_id_once(spark):
    """One id on 100,000 rows is one text of the fit, and no task ranks what all rows of a language have sent."""
    many = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("ba ko mi").alias("text"), F.lit("x").alias("lang"))
    few = [(i, "ba ko mi " * (i % 5 + 1), "x") for i in range(50)] + [(100 + i, "schu nge ei " * (i % 5 + 1), "y") for i in range(50)]
    docs = many.unionByName(spark.createDataFrame(few, "doc_id long, text string, lang string"))
    model = langid.fit(spark, docs)
    assert model.labels == ["x", "y"] and model.predict(["mi ko ba", "nge schu"])[0] == ["x", "y"]
    labels = spark.createDataFrame([(r[0], int(r[2] == "y")) for r in few] + [(7, 0)] * 20, "doc_id long, toxic int")
    found = toxicity.fit(spark, docs, labels)
    assert (found.score(["nge schu", "ba ko"])[0] >= 0.5).tolist() == [True, False]


def test_the_fit_is_bounded_by_characters(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: taken.append(texts))
    monkeypatch.setattr(toxicity, "FIT_CHARS", 1000)
    docs = spark.createDataFrame([(i, "a" * (10 if i % 4 else 900)) for i in range(80)], "doc_id long, text string")
    toxicity.fit(spark, docs, docs.selectExpr("doc_id", "0 AS toxic"))
    assert 10 <= len(taken[0]) <= 100 and sum(map(len, taken[0])) <= 1000
