"""Huffman coding by round trips; token-id files against the tokenizer library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanery.llm import huffman, idfiles
from gleanery.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = ["a", "B", " ", "\n", "\t", "'s", "é", "1", "!", "\x1c", "\x85", "ΑΣ", "aa.", "The", "ING", "日本", "\U0001f600", "<|endoftext|>", "<|EndOfText|>", "İ", "don't", "..", ".,", "\x0b"]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=3000), st.integers(6, 16))
def test_codes_round_trip(ids, limit):
    ids = np.array(ids, dtype=np.int64)
    counts = np.bincount(ids, minlength=41)
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(float)
    assert (lengths > 0).tolist() == (counts > 0).tolist() and lengths.max() <= limit and (2.0**-used).sum() <= 1
    stream, offsets = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
    sizes = np.array([min(huffman.BLOCK_IDS, len(ids) - k) for k in range(0, len(ids), huffman.BLOCK_IDS)], dtype=np.int64)
    assert huffman.decode(stream, offsets, sizes, huffman.decode_table(lengths, limit)).tolist() == ids.tolist()


def test_lengths_are_optimal_and_limited():
    fibonacci = [1, 1]
    while len(fibonacci) < 24:
        fibonacci.append(sum(fibonacci[-2:]))
    counts = np.array(fibonacci)
    free, short = huffman.code_lengths(counts, 30), huffman.code_lengths(counts, 8)
    assert free.max() == 23 and short.max() == 8
    assert (2.0 ** -free.astype(float)).sum() == 1 == (2.0 ** -short.astype(float)).sum()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(300), 8)


def test_words_equal_library():
    rng = random.Random(3)
    texts = ["", " ", *("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(1500))]
    with open(PATH, "rb") as file:
        ids, ends = idfiles.WordTokenizer(file.read()).encode_batch(pa.array(texts))
    start = 0
    for text, end in zip(texts, ends, strict=True):
        assert ids[start:end].tolist() == library_ids(text), repr(text)
        start = end


def test_files(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(idfiles, "READ_IDS", 40)  # the reader's own process keeps its own value; read_file is called here
    texts = [None, "", "One two, three!", "One two, three!", "word " * 3000]
    docs = make_docs(*texts, ids=[5, None, 2, 2, 9]).repartition(3)
    manifest = idfiles.write_corpus(spark, docs, folder=str(tmp_path / "ids"))
    expected = sorted(zip([5, -1, 2, 2, 9], [library_ids(t or "") + [1] for t in texts], strict=True))
    start, want = 0, []
    for key, ids in expected:
        want.append((None if key < 0 else key, start, len(ids), ids))
        start += len(ids)
    rows = idfiles.read(spark, manifest).orderBy("start").collect()
    assert [(r.key, r.start, r.n_tokens, r.ids) for r in rows] == want
    again = []
    for f in sorted(manifest.collect(), key=lambda r: r.part):
        for keys, _, sizes, spans in idfiles.read_file(f.path):
            again += list(zip(keys.to_pylist(), sizes.tolist(), [s.tolist() for s in spans], strict=True))
    assert again == [(k, n, ids) for k, _, n, ids in want]


def test_empty_table(spark, make_docs):
    manifest = idfiles.write_corpus(spark, make_docs("a").limit(0))
    assert idfiles.read_digests(spark, manifest).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op8_id_files"](spark, folder).collect()}
    start = 0
    for d in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        ids = library_ids(d.text or "") + [1]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        r = rows.pop(d.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    assert not rows


def test_words_of_any_letters_and_their_marks_share_the_library_calls(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        tokenizer = idfiles.WordTokenizer(file.read())
    texts = ["été été.$$$ déjà*** déjà,", "İstanbul. क़) क़. ét. ΣΑΣ, ß_ x²! don't. l'été,"]
    asked, ask = [], tokenizer._ask
    monkeypatch.setattr(tokenizer, "_ask", lambda runs: (asked.extend(runs), ask(runs)))
    ids, ends = tokenizer.encode_batch(pa.array(texts))
    found = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    assert found == [e.ids for e in tokenizer.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert "été.$$$".encode() not in asked and "déjà***".encode() not in asked and "été".encode() in asked


def encoded(tokenizer, texts):
    ids, ends = tokenizer.encode_batch(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def test_a_word_is_asked_once_whatever_marks_and_digits_stand_around_it(monkeypatch):
    with open(PATH, "rb") as file:
        tokenizer = idfiles.WordTokenizer(file.read())
    asked, ask = [], tokenizer._ask
    monkeypatch.setattr(tokenizer, "_ask", lambda runs: (asked.extend(runs), ask(runs)))
    for texts in ["(Red) red, red-red red2red [été]-été! red"], ["", None], ["«red red's 'tis (red", "red/red's"]:
        texts = [t or "" for t in texts]
        assert encoded(tokenizer, texts) == [library_ids(t) for t in texts]
    assert sorted(asked) == sorted(p.encode() for p in "red été ( ) , - 2 [ ]- ! «red 's 'tis /".split())


def test_forgotten_pieces_are_asked_again(monkeypatch):
    monkeypatch.setattr(idfiles, "CACHE_BYTES", 400)
    with open(PATH, "rb") as file:
        tokenizer = idfiles.WordTokenizer(file.read())
    rng = random.Random(5)
    for _ in range(30):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 20))) for _ in range(20)]
        assert encoded(tokenizer, texts) == [library_ids(t) for t in texts]
        tokenizer._forget()
        assert len(tokenizer.known) <= 400 // 20 and tokenizer.bounds[-1] == len(tokenizer.ids)
        assert len(tokenizer.known) == len(tokenizer.met) == len(tokenizer.bounds) - 1


def test_any_character_next_to_letters_marks_and_digits():
    with open(PATH, "rb") as file:
        tokenizer = idfiles.WordTokenizer(file.read())
    points = [*range(0x3000), *range(0x3000, 0x20000, 13)]
    texts = [f"{c}! a{c}s.{c}{c}'s{c}1 ({c}) '{c}-á{c}={c}" for c in map(chr, points) if not "\ud800" <= c <= "\udfff"]
    want = LIBRARY.encode_batch_fast(texts, add_special_tokens=False)
    assert encoded(tokenizer, texts) == [w.ids for w in want]
