"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Confidence is calibrated by a temperature fitted on labelled texts that the gradient never saw; a text is
rejected (``und``) if it has no letter, or if its confidence is below a threshold set from those same texts.

Defined results: NULL, empty and letterless texts are ``und`` with score 0; ties go to the label first in
order; without any labelled text everything is ``und``; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flattext
from .common import below_share, slices, texts_of, tidy, with_output

UNKNOWN = "und"
SIZES = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSIONS = 16
EPOCHS = 8
#: Least number of SGD steps, for a few texts.
STEPS = 800
RATE = 4.0
#: Labelled texts taken per language to fit the model, the smallest by a hash of their id; it bounds the fit.
TEXTS_PER_LABEL = 800
#: Languages that can be learned, the most frequent ones.
LABELS = 400
#: Longest text (in characters) that is taken to fit the model; prediction reads every text whole.
FIT_CHARS = 50_000
#: Share of them that only calibrates.
CALIBRATION = 0.25
#: Share of the least confidence among right calibration texts that is still accepted.
MARGIN = 0.9
_PART = 1 << 19


@dataclass
class LanguageModel:
    labels: list[str]
    scores: np.ndarray  # bucket x label: embedding times output weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Averaged scores and the number of subwords of each text."""
        total = np.zeros((len(texts), len(self.labels)))
        count = np.zeros(len(texts), dtype=np.int64)
        first, held, group = 0, 0, []
        for i, text in enumerate([*texts, None]):
            if text is None or held + len(text) > _PART and group:
                sums, n = self._sums(group)
                total[first:i], count[first:i] = sums, n
                first, held, group = i, 0, []
            if text is not None:
                group.append(text)
                held += len(text)
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), dtype=np.int64)
        if not texts:
            return sums, counts
        points, starts = flattext.flatten(texts)
        where, bucket = flattext.subwords(points, SIZES, BUCKETS)
        owner = np.searchsorted(starts, where, side="right") - 1
        counts += np.bincount(owner, minlength=len(texts))[: len(texts)]
        for k in range(len(self.labels)):
            sums[:, k] = np.bincount(owner, self.scores[:, k][bucket], minlength=len(texts))[: len(texts)]
        return sums, counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, calibrated confidence and whether the text is rejected."""
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        z, count = self.logits(texts)
        p = _softmax(z / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(count > 0, p[np.arange(len(texts)), best], 0.0)
        labels = [self.labels[b] if n else UNKNOWN for b, n in zip(best, count, strict=True)]
        return labels, score, (count == 0) | (score < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(flattext.subwords(flattext.flatten([text])[0], SIZES, BUCKETS)[1], return_counts=True)
    return found, counts / max(1, counts.sum())


def train(texts: list[str], langs: list[str], seed: int = 7) -> LanguageModel:
    """Plain SGD over mini-batches with a linearly falling rate; the result depends on the given rows only."""
    labels = sorted(set(langs))
    if not labels:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    bags = [_features(t) for t in texts]
    target = np.array([labels.index(x) for x in langs])
    usable = np.array([i for i, (f, _) in enumerate(bags) if len(f)], dtype=np.int64)
    rng.shuffle(usable)
    cut = int(len(usable) * (1 - CALIBRATION)) if len(usable) >= 8 else len(usable)
    fit, held = usable[:cut], usable[cut:] if cut < len(usable) else usable
    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    out, bias = np.zeros((DIMENSIONS, len(labels))), np.zeros(len(labels))
    batch, done = 16, 0
    per_epoch = max(1, -(-len(fit) // batch))
    epochs = max(EPOCHS, -(-STEPS // per_epoch))
    steps = epochs * per_epoch
    for _ in range(epochs):
        rng.shuffle(fit)
        for start in range(0, len(fit), batch):
            rate = RATE * (1 - done / steps)
            done += 1
            rows = fit[start : start + batch]
            ids = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            cuts = np.cumsum([0, *(len(bags[r][0]) for r in rows[:-1])])
            mean = np.add.reduceat(embed[ids] * share[:, None], cuts, axis=0)
            error = _softmax(mean @ out + bias)
            error[np.arange(len(rows)), target[rows]] -= 1
            error /= len(rows)
            back = error @ out.T
            out -= rate * mean.T @ error
            bias -= rate * 0.1 * error.sum(axis=0)
            owner = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            np.add.at(embed, ids, -rate * len(labels) * share[:, None] * back[owner])
    model = LanguageModel(labels, embed @ out, bias, 1.0, 0.0)
    z, _ = model.logits([texts[i] for i in held])
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(_softmax(z / t)[np.arange(len(held)), target[held]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = _softmax(z / model.temperature)
    right = p.argmax(axis=1) == target[held]
    least = p.max(axis=1)[right].min() if right.any() else 1.0
    chance = 1 / len(labels)
    model.threshold = float(min(0.5, max(chance + 0.02, MARGIN * least))) if len(labels) > 1 else 0.0
    return model


def fit(spark: SparkSession, docs: DataFrame, usable: Column | None = None) -> LanguageModel:
    """Fits on at most ``TEXTS_PER_LABEL`` labelled texts of each of the ``LABELS`` most frequent languages among the
    ``usable`` rows; a text counts once per id and language, the first in order where they differ."""
    use = usable if usable is not None else F.lit(True)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), docs["text"].alias("text"), use.alias("use"))
    rows = rows.where("use AND lang IS NOT NULL AND doc_id IS NOT NULL").where(F.length("text") <= FIT_CHARS)
    # Distinct ids, since a repeated one has one hash; the estimate's error is far below the share's slack.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS)
    counts = spark.createDataFrame(counts.collect(), counts.schema)
    low = rows.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(below_share(F.col("doc_id"), TEXTS_PER_LABEL, F.col("n")))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = low.select("doc_id", "lang").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= TEXTS_PER_LABEL)
    chosen = spark.createDataFrame(few.select("doc_id", "lang").collect(), rows.select("doc_id", "lang").schema)
    found = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return train([r.text for r in found], [r.lang for r in found])


def predict(
    spark: SparkSession, docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "lang_"
) -> DataFrame:
    """All columns of ``docs`` with lang_pred, lang_score and lang_rejected, or such names behind another prefix."""
    sent = spark.sparkContext.broadcast(model)
    added = T.StructType.fromDDL(f"{prefix}pred string, {prefix}score double, {prefix}rejected boolean")
    fields = [(n, None) for n in docs.columns] + list(zip(added.names, (pa.string(), pa.float64(), pa.bool_()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                labels, score, rejected = sent.value.predict(texts_of(part, text).to_pylist())
                yield with_output(fields, [*part.columns, labels, score, rejected])
            tidy()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))
