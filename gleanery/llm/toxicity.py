"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A sentence's logit is a bias plus the weights of its distinct words and of their beginnings, which stand for a
stem under any ending. Weights are never negative and mostly zero, so that only evidence counts: harmless words, however
many, neither hide nor make an offence. A document is toxic if any sentence is, so its score
is one minus the product of the sentences' complements. Only document labels are needed to fit the weights, and
the fitted sentence scores then say where the offence stands.

Defined results: NULL and empty texts are one empty sentence; documents without labels are scored but never
learned from; of several labels of a document each counts; without any label every score is that of the bias.
Length is no evidence: sentences that score below ``FAINT`` are left out of the noisy-or unless they are the worst.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flattext
from .common import below_share, slices, texts_of, tidy, with_output

#: Labelled documents taken to fit the model, the smallest by a hash of their id; it bounds the fit.
FIT_DOCS = 5000
#: Characters of all texts of the fit; one that would exceed what is left is passed over for the next.
FIT_CHARS = 30_000_000
#: Score from which a sentence counts beside the worst one. The faint scores of many harmless ones would add up.
FAINT = 0.5
#: Fitting documents that must hold a word for it to get a weight.
MIN_DOCS = 4
ROUNDS = 200
RATE = 0.15
#: Pull of every weight towards zero, per document.
SPARSITY = 1e-4
#: Beginnings of longer words that are features beside the word.
STEMS = (4, 5, 6)
_PART = 1 << 19


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def features(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every word, and of the beginnings of longer words."""
    starts, ends, spelled = flattext.words(points)
    places, found = [starts], [spelled]
    for size in STEMS:
        longer = starts[ends - starts > size]
        places.append(longer)
        found.append(flattext.spelling(points, longer, longer + size) ^ np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)))
    return np.concatenate(places), np.concatenate(found)


@dataclass
class ToxicityModel:
    words: np.ndarray  # sorted hashes of the features that have weights
    weights: np.ndarray
    bias: float

    def _logits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentence number of every place, and the logit of every sentence."""
        of = flattext.sentences(points)
        starts, spelled = features(points)
        at = np.searchsorted(self.words, spelled)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == spelled[known]
        n = len(self.words)
        once = np.unique(of[starts[known]] * n + at[known]) if n else np.zeros(0, dtype=np.int64)
        z = np.bincount(once // max(n, 1), self.weights[once % max(n, 1)], minlength=int(of[-1]) + 1)
        return of, z + self.bias

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the noisy-or score, the highest sentence score, and that sentence's number (from 0)."""
        score, top, where = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        first, held, group = 0, 0, []
        for i, text in enumerate([*texts, None]):
            if text is None or held + len(text) > _PART and group:
                if group:
                    score[first:i], top[first:i], where[first:i] = self._score(group)
                first, held, group = i, 0, []
            if text is not None:
                group.append(text)
                held += len(text)
        return score, top, where

    def _score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points, starts = flattext.flatten(texts)
        of, z = self._logits(points)
        begin = of[starts[:-1]]
        stop = np.append(begin[1:], of[starts[-1]])
        best = np.array([begin[k] + int(z[begin[k] : stop[k]].argmax()) for k in range(len(texts))])
        none = np.logaddexp(0, z)
        faint = z < np.log(FAINT / (1 - FAINT))
        faint[best] = False
        none[faint] = 0
        sums = np.add.reduceat(none, begin)
        sums[-1] = none[begin[-1] : stop[-1]].sum()
        score = -np.expm1(-sums)
        return score, _sigmoid(z[best]), best - begin

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end (in characters) and score of every sentence of the text."""
        points, _ = flattext.flatten([text])
        of, z = self._logits(points)
        edges = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
        spans = zip(edges.tolist(), [*edges[1:].tolist(), len(points)], strict=True)
        p = _sigmoid(z[of[edges]])
        return [(a, min(b - 1, len(text)), float(s)) for (a, b), s in zip(spans, p, strict=True) if a < max(1, len(text))]


def train(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Full-batch Adam on the document log loss; equal texts with equal labels count once."""
    rows = list(dict.fromkeys(zip(texts, toxic, strict=True)))
    if not rows:
        return ToxicityModel(np.zeros(0, dtype=np.uint64), np.zeros(0), -6.0)
    hashes, owners, firsts, total = [], [], [], 0
    for k in range(0, len(rows), 256):  # by parts, so that only features are held
        points, starts = flattext.flatten([t for t, _ in rows[k : k + 256]])
        of = flattext.sentences(points)
        at, spelled = features(points)
        order = np.lexsort((spelled, of[at]))
        where, what = of[at][order], spelled[order]
        new = np.concatenate(([True], (where[1:] != where[:-1]) | (what[1:] != what[:-1])))[: len(where)]
        owners.append((where[new] + total).astype(np.int32))
        hashes.append(what[new])
        firsts.append(of[starts[:-1]] + total)
        total += int(of[-1])
    sentence, first, n = np.concatenate(owners), np.concatenate(firsts), total
    vocabulary, token = np.unique(np.concatenate(hashes), return_inverse=True)
    doc_of = np.maximum(np.searchsorted(first, np.arange(n + 1), side="right") - 1, 0)
    met = np.unique(token * len(rows) + doc_of[sentence]) // len(rows)
    frequent = np.bincount(met, minlength=len(vocabulary)) >= MIN_DOCS
    use = frequent[token]
    token, sentence = (np.cumsum(frequent) - 1)[token[use]], sentence[use]
    y = np.array([t for _, t in rows], dtype=np.float64)
    w, bias = np.zeros(int(frequent.sum())), -6.0
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(sentence, w[token], minlength=n + 1) + bias
        none = np.logaddexp(0, z)
        none[0] = none[n] = 0  # before the first text and after the last
        total = np.bincount(doc_of, none, minlength=len(rows))
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
        g = pull[doc_of] * _sigmoid(z)
        g[0] = g[n] = 0
        grad = np.append(np.bincount(token, g[sentence], minlength=len(w)) / len(rows) + SPARSITY, g.sum() / len(rows))
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        w = np.maximum(w - move[:-1], 0.0)
        bias -= move[-1]
    used = w > 0
    return ToxicityModel(vocabulary[frequent][used], w[used], float(bias))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> ToxicityModel:
    """Fits on at most ``FIT_DOCS`` labels among the ``usable`` rows of ``labels``, the smallest by a hash of the id, and
    at most ``FIT_CHARS`` characters of their documents; of several texts of an id the shortest is taken."""
    rows = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("toxic"), (usable if usable is not None else F.lit(True)).alias("use"))
    rows = rows.where("use AND doc_id IS NOT NULL AND toxic IS NOT NULL")
    low = rows.where(below_share(F.col("doc_id"), FIT_DOCS, rows.agg(F.approx_count_distinct("doc_id")).first()[0]))
    few = low.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(FIT_DOCS).select("doc_id", "toxic").collect()
    if not few:
        return train([], [])
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).where("text IS NOT NULL")
    drawn = spark.createDataFrame(list(dict.fromkeys((r.doc_id,) for r in few)), rows.select("doc_id").schema)
    # One text per id, so that an id on very many rows is one text of the fit.
    one = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("t"))
    lengths = {r.doc_id: (r.t.n, r.t.h) for r in one.collect()}
    left, taken = FIT_CHARS, {}
    for r in few:  # in the order of the hash
        if r.doc_id in taken or r.doc_id not in lengths:
            continue
        n, h = lengths[r.doc_id]
        if n <= left:
            left -= n
            taken[r.doc_id] = h
    if not taken:
        return train([], [])
    chosen = spark.createDataFrame([*taken.items()], rows.select("doc_id").schema.add("h", "long"))
    same = texts.join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("h"))
    bodies = {r.doc_id: r.text for r in same.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    found = sorted((r.doc_id, bodies[r.doc_id], int(r.toxic)) for r in few if r.doc_id in bodies)
    return train([text for _, text, _ in found], [toxic for _, _, toxic in found])


def score(spark: SparkSession, docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``score``, and score and number of the worst sentence of every whole text."""
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    fields = [("doc_id", None), ("score", pa.float64()), ("sentence_score", pa.float64()), ("sentence", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield with_output(fields, [part.column(0), *sent.value.score(texts_of(part).to_pylist())])
            tidy()

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, sentence_score double, sentence long")


def offending_sentences(
    spark: SparkSession, docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every sentence that scores at least ``threshold``: doc_id, its span in characters, score and text."""
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    fields = [("doc_id", None), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, out = part.column(0), []
                for i, t in enumerate(texts_of(part).to_pylist()):
                    out += [(i, a, b, s, t[a:b]) for a, b, s in sent.value.sentences(t) if s >= threshold]
                index, *rest = zip(*out, strict=True) if out else [()] * 5
                yield with_output(fields, [keys.take(pa.array(index, pa.int64())), *map(list, rest)])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, end long, score double, sentence string")
