"""BPE against the tokenizer library, text by text."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from gleanery.llm import bpe
from gleanery.llm.queries import QUERIES

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = ["a", "b", " ", "\n", "\t", "'s", "é", "1", "!", "\x1c", "\x85", "aa", " the", "ing", "日本", "\U0001f600", "　"]


def texts():
    rng = random.Random(5)
    found = ["", " ", "  ", "a  b", "a   b \n c", "\n\n x", "it's we'll 12 3", "é" * 3000, "a" * 4000, " \n", " a\n b \t\tc"]
    found += ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    return found + ["".join(rng.choice("abcdeghinorstTHE,.") for _ in range(rng.randint(0, 60))) for _ in range(500)]


def test_batch_equals_library():
    given = texts()
    ids, ends = bpe.ByteBpe(RANKS).encode_batch(pa.array(given))
    start = 0
    for text, end in zip(given, ends, strict=True):
        assert ids[start:end].tolist() == LIBRARY.encode_ordinary(text), repr(text)
        start = end


def test_long_text_in_runs_and_bounded_memory(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    encoder = bpe.ByteBpe(RANKS)
    text = " ".join(texts())
    runs = list(encoder.runs(text, 50))
    assert len(runs) > 20 and "".join(runs) == text
    parts = [encoder.encode_batch(pa.array([run]))[0] for run in runs]
    assert np.concatenate(parts).tolist() == LIBRARY.encode_ordinary(text)


def test_a_lower_rank_that_a_merge_brings_about_comes_first():
    """Ranks in which an early merge needs a later one: replay must agree with merging word by word."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bcd", b"ab", b"cd", b"abcabc"]
    ranks = {t: i for i, t in enumerate(tokens)}
    library = tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["abcabc", "abcdabcd", "ababcdcd", "abab", "bcdbcdabc", "aabbccdd"]
    ids, ends = bpe.ByteBpe(ranks).encode_batch(pa.array(words))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode_ordinary(w) for w in words]


def test_operators(spark, make_docs):
    docs = make_docs(None, "", "Hello  world", "Hello  world", "x" * 20_000, ids=[1, 2, 3, 3, None])
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(spark, docs).collect()}
    expected = set()
    for key, text in [(1, ""), (2, ""), (3, "Hello  world"), (None, "x" * 20_000)]:
        ids = LIBRARY.encode_ordinary(text)
        packed = np.array(ids, dtype="<u4").tobytes()
        expected.add((key, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == expected
    back = bpe.decode(spark, bpe.encode(spark, docs)).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(["", "", "Hello  world", "Hello  world", "x" * 20_000])
    assert bpe.round_trip(spark, docs.limit(0), with_ids=True).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    rows = {r.doc_id: r for r in QUERIES["op6_byte_bpe"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = LIBRARY.encode_ordinary(d.text or "")
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_long_words_as_the_library(monkeypatch):
    """Words of one letter, of few letters and of any, on both sides of the length that is merged by itself."""
    made = bpe.ByteBpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made.ranks, special_tokens={})
    rng = random.Random(4)
    words = ["a" * 3000, "=" * 5000, "ab" * 2500, "".join(rng.choice("abcdeé") for _ in range(9000)), "z" * bpe.LONG_WORD, "z" * (bpe.LONG_WORD + 1)]
    for word in words:
        assert made.encode(word).tolist() == library.encode_ordinary(word)
    for word in words:
        assert made.merged(word.encode()) == made.replay([word.encode()])[0]
    ids = made.encode("a" * 1_000_000)
    assert made.decode(ids) == b"a" * 1_000_000 and len(set(ids.tolist())) == 1


def test_a_task_leaves_no_words_behind(spark, make_docs):
    made = bpe.ByteBpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    made.encode("some words to remember")
    assert made.words or made.chunks
    made.forget()
    assert not made.words and not made.chunks and not made.words.old


def test_workers_are_given_the_pairs(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"abca": 259}
    pairs = bpe.pairs_of(ranks)
    assert pairs[0].tolist()[-1] == 1 << 62 and sorted(set(pairs[1].tolist())) == [-1, 256, 257, 258, 259]
    whole = bpe.ByteBpe(ranks).encode("abcabc bcab")
    monkeypatch.setattr(bpe, "pairs_of", None)
    assert bpe.ByteBpe(ranks, pairs=pairs).encode("abcabc bcab").tolist() == whole.tolist()
