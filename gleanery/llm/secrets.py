"""Secret scan: candidates by shape, false positives removed by a random forest over what they look like.

Candidates are long unbroken runs of letters and digits, and values assigned to a telling name. A candidate is
described by its length, the transitions between kinds of characters, how much of it dictionary words cover,
its likeness to a path, and the words beside it; the forest is trained from labelled findings. ``known_labels``
labels findings whose format decides: issued key formats and assigned random values against identifiers, paths
and words. Whatever fits none of them is not labelled, and the forest scores it untaught. The format itself is no
feature. Punctuation that ends an assigned value is not part of it, down to ``NAMED_LETTERS`` characters.

Defined results: NULL and empty texts have no candidates; repeated rows repeat their findings; equal spans are
found once; without findings of both labels nothing is removed and the score is 1; runs of any length are one
candidate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import materialize, slices, texts_of, with_output

_RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
_NAMED = r"(?P<name>(?<![A-Za-z_\-])[A-Za-z_\-]{0,40}?(?:password|passwd|pwd|secret|token|key|auth)[A-Za-z_\-]{0,40})\s{0,3}[:=]\s{0,3}[\"']?(?P<value>[^\s\"']{6,})"
_CANDIDATE = re.compile(rf"{_NAMED}|(?P<run>{_RUN})", re.I)
_WORD = re.compile(r"[^\W_]+")
_KINDS = (str.islower, str.isupper, str.isdigit)
TELLING = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "api", "id", "uuid", "sha", "commit", "hash", "http", "www")
FEATURES = [
    "length", "lower", "upper", "digit", "other", "changes", "entropy", "distinct", "longest_kind", "hex",
    "covered", "longest_word", "slashes", "dots", "dashes", "extension", "quoted", "assigned",
    *[f"near_{w}" for w in TELLING], "word_before", "word_after",
]
#: Shortest assigned value, and the characters that may follow one without a space.
NAMED_LETTERS = 6
_BEHIND = ";,.:)]}>`"
#: Characters before and after a candidate in which neighbouring words are looked for.
NEAR = 48
#: Shortest dictionary word, and the vocabulary it comes from.
WORD_LETTERS = 4
TREES, DEPTH, SEED = 40, 8, 11
#: Labelled findings taken to fit the forest, the smallest by a hash of their place; it bounds the fit.
FIT_FINDINGS = 50_000

# Formats that issuers publish, and formats of identifiers that are no secrets.
SECRET_FORMATS = [r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"sk_live_[A-Za-z0-9]{24,}", r"xox[abp]-[A-Za-z0-9-]{10,}", r"AIza[0-9A-Za-z_\-]{35}"]
PLAIN_FORMATS = [r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"[A-Za-z_\-]+", r"[0-9\-+/]+", r"[A-Za-z0-9_\-]*(?:/[A-Za-z0-9_\-]*)+"]
#: Share covered by dictionary words from which a value of no listed format counts as words.
WORDY = 0.7
ASSIGNED_FORMAT = r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_\-]{12,}={0,2}"


def dictionary(path: str | None = None) -> frozenset[str]:
    """Lower-case words of at least ``WORD_LETTERS`` letters in a public vocabulary."""
    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = (t.decode("utf-8", "ignore").strip() for t in ranks)
    return frozenset(w.lower() for w in found if len(w) >= WORD_LETTERS and w.isalpha() and w.isascii())


def _covered(value: str, words: frozenset[str], longest: int = 16) -> tuple[float, int]:
    """Share of the characters that dictionary words cover, longest first from the left; and the longest word."""
    low, at, hit, most = value.lower(), 0, 0, 0
    while at < len(low):
        for size in range(min(longest, len(low) - at), WORD_LETTERS - 1, -1):
            if low[at : at + size] in words:
                hit += size
                most = max(most, size)
                at += size
                break
        else:
            at += 1
    return hit / max(1, len(low)), most


def describe(text: str, start: int, end: int, words: frozenset[str], assigned: bool) -> list[float]:
    value = text[start:end]
    n = len(value)
    kinds = [next((i for i, test in enumerate(_KINDS) if test(c)), 3) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    longest = run = 1
    for a, b in zip(kinds, kinds[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    counts = np.unique(list(value), return_counts=True)[1] / n
    covered, word = _covered(value, words)
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    beside = (before + " " + after).lower()
    head, tail = _WORD.findall(before), _WORD.findall(after)
    return [
        math.log1p(n), *share, changes, float(-(counts * np.log2(counts)).sum()), len(counts) / n, longest / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n, covered, float(word), value.count("/") / n,
        value.count(".") / n, value.count("-") / n, float(bool(re.search(r"\.[a-z]{2,4}$", value))),
        float(before[-1:] in ("'", '"')), float(assigned), *[float(w in beside) for w in TELLING],
        float(bool(head) and head[-1].lower() in words), float(bool(tail) and tail[0].lower() in words),
    ]


def candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start and end (in characters) of every candidate, and whether a name is assigned to it."""
    for found in _CANDIDATE.finditer(text):
        named = found.group("value") is not None
        start, end = found.span("value" if named else "run")
        if named:
            end = start + max(NAMED_LETTERS, len(text[start:end].rstrip(_BEHIND)))
        yield start, end, named


def scan(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Every candidate with its features: doc_id, start, end, value, assigned, features."""
    sent = spark.sparkContext.broadcast(dictionary(path))
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    fields = [("doc_id", None), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("assigned", pa.bool_()), ("features", pa.list_(pa.float64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = [
                    (i, a, b, t[a:b], named, describe(t, a, b, sent.value, named))
                    for i, t in enumerate(texts_of(part).to_pylist())
                    for a, b, named in candidates(t)
                ]
                index, *rest = zip(*out, strict=True) if out else [()] * 6
                yield with_output(fields, [part.column(0).take(pa.array(index, pa.int64())), *map(list, rest)])

    kind = rows.schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, start long, end long, value string, assigned boolean, features array<double>"
    return rows.mapInArrow(run, schema)


def known_labels(findings: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for issued formats and assigned random values, 0 for plain formats and words, else NULL."""
    whole = lambda formats: "^(?:" + "|".join(formats) + ")$"
    value = F.col("value")
    label = (
        F.when(value.rlike(whole(SECRET_FORMATS)), 1)
        .when(value.rlike(whole(PLAIN_FORMATS)), 0)
        .when(F.col("assigned") & value.rlike(whole([ASSIGNED_FORMAT])), 1)
        .when(~F.col("assigned") & value.rlike("[0-9]"), F.lit(None))
        .when(F.col("features")[FEATURES.index("covered")] >= WORDY, 0)
    )
    return findings.withColumn("label", label.cast("int"))


class SecretModel:
    """A random forest over ``FEATURES``; None where the labels gave it nothing to tell apart."""

    def __init__(self, forest) -> None:
        self.forest = forest

    def score(self, findings: DataFrame) -> DataFrame:
        """Adds ``score``, the forest's share for a real secret."""
        if self.forest is None:
            return findings.withColumn("score", F.lit(1.0))
        from pyspark.ml.functions import array_to_vector, vector_to_array

        shown = self.forest.transform(findings.withColumn("_vector", array_to_vector("features")))
        return shown.select(*findings.columns, vector_to_array("_probability")[1].alias("score"))


def fit(findings: DataFrame, label: str = "label") -> SecretModel:
    """Trains the forest from labelled findings: rows with ``features`` and a 0 or 1 ``label``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    place = F.xxhash64("doc_id", "start")
    rows = findings.where(F.col(label).isNotNull()).withColumn("_place", place).orderBy("_place", "doc_id", "start").limit(FIT_FINDINGS)
    rows = rows.select(array_to_vector("features").alias("_vector"), F.col(label).cast("double").alias("_label"))
    if rows.agg(F.count_distinct("_label")).first()[0] < 2:
        return SecretModel(None)
    forest = RandomForestClassifier(
        featuresCol="_vector", labelCol="_label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
        numTrees=TREES, maxDepth=DEPTH, seed=SEED,
    )
    return SecretModel(forest.fit(rows))


def find_secrets(spark: SparkSession, docs: DataFrame, threshold: float = 0.5, **names: str) -> DataFrame:
    """All candidates with score and ``secret`` (score at or above the threshold), trained by ``known_labels``."""
    found = materialize(scan(spark, docs, **names), spark, "findings")
    model = fit(known_labels(found))
    return model.score(found).withColumn("secret", F.col("score") >= threshold)
