"""Token-id files: texts encoded by a public word tokenizer, Huffman-coded over global counts, and read back.

Layout of a file, all integers little-endian: magic; the coded blocks; per document a 64-bit key,
a byte saying whether the key is there, and a 64-bit length; one 64-bit bit offset and one 32-bit id count per block; one byte of code length per vocabulary id; a JSON
footer with the sizes; its 32-bit length; magic. Files are written in ascending key order, so that the manifest
(one row per file) gives every document's place in the whole corpus.

Defined results: a NULL text has only the end id; NULL keys come first; rows with equal keys are ordered by
their ids; an empty table writes no file and reads back no row.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_dir
from . import huffman
from .common import SLICE_BYTES, gather, materialize, slices, texts_of, with_output

MAGIC = b"GLIDF1\n\0"
#: Bytes of pieces of text, their ids and places kept per Python worker from one slice to the next; it only bounds memory.
CACHE_BYTES = 48 << 20
#: Words given to the library in one text.
JOINED_WORDS = 500
#: Texts per call of the library, whose results are many times larger than the ids taken from them.
ASKED_TEXTS = 16
#: Ids decoded at a time while reading a file, by whole documents.
READ_IDS = 1 << 21
#: Ids coded in one call while writing; whole blocks.
RUN_IDS = 64 * huffman.BLOCK_IDS
_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=2), zstandard.ZstdDecompressor()
#: Kinds of bytes: white space, letters, digits, ASCII marks, apostrophes, and what is left.
SPACE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(6)
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@functools.cache
def _letters() -> np.ndarray:
    """Which code points below 0x10000 are letters, composed and lower-cased too, in every Unicode version of the library."""
    old, found = unicodedata.ucd_3_2_0, np.zeros(1 << 16, dtype=bool)
    for c in map(chr, range(0x80, 1 << 16)):
        found[ord(c)] = old.category(c)[0] == "L" and unicodedata.normalize("NFC", c).lower().isalpha()
    return found


def _kind_table() -> bytes:
    table = bytearray([OTHER]) * 256
    for kind, members in ((SPACE, b" \t\n\x0b\f\r"), (DIGIT, b"0123456789"), (MARK, _MARKS), (APOSTROPHE, b"'")):
        for c in members:
            table[c] = kind
    for c in (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)):
        table[c] = LETTER
    return bytes(table)


def _end_table() -> bytes:
    """Whether a piece ends between two bytes, by 8 times the first one's kind plus the second one's."""
    table = bytearray(256)
    ends = {
        SPACE: range(6), LETTER: (DIGIT, MARK, APOSTROPHE), DIGIT: (LETTER, DIGIT, MARK, APOSTROPHE),
        MARK: (LETTER, DIGIT), APOSTROPHE: (DIGIT,), OTHER: (),
    }
    for first, seconds in ends.items():
        for second in (SPACE, *seconds):
            table[8 * first + second] = 1
    return bytes(table)


_BYTE_KINDS, _ENDS = _kind_table(), _end_table()


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8 text; all bytes of a letter are of the kind letter."""
    kinds = np.frombuffer(bytearray(data.tobytes().translate(_BYTE_KINDS)), dtype=np.uint8)
    for low, high, more in ((0xC2, 0xE0, 1), (0xE0, 0xF0, 2)):
        at = np.flatnonzero((data >= low) & (data < high))
        if not len(at):
            continue
        point = (data[at] & (0x1F if more == 1 else 0x0F)).astype(np.uint16)
        for k in range(1, more + 1):
            point = point << 6 | data[at + k] & 0x3F
        at = at[_letters()[point]]
        for k in range(more + 1):
            kinds[at + k] = LETTER
    return kinds


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of the lower-cased texts that the pattern never matches across, and the bound of each text's among them.

    They end at white space, where letters, digits and ASCII marks meet, and after digits. An apostrophe stays with
    what follows, since it may open a piece with letters; what is none of these kinds stays with its neighbours.
    """
    lower = pc.ascii_lower(texts).cast(pa.large_binary())
    bounds = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset : lower.offset + len(lower) + 1]
    held = lower.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[bounds[0] : bounds[-1]] if held and held.size else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    kinds = _kinds(data)
    inside = kinds != SPACE
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(_ENDS), dtype=bool)
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    begins &= inside
    kept = data[inside]
    offsets = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return found, np.searchsorted(np.flatnonzero(begins), bounds)


class WordTokenizer:
    """The library's tokenizer, asked once per distinct piece of the texts.

    Its pattern never matches white space, it lower-cases letter by letter and composes no letter with a space or an
    ASCII mark, so the pieces are independent. Texts that hold special-token marks are given to the library whole.
    """

    def __init__(self, spec: bytes) -> None:
        # a task has one core; the library's threads would only take those of other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        #: Known pieces, the slice that last held each, and their ids: those of piece i are ids[bounds[i]:bounds[i + 1]].
        self.known, self.met, self.slices = pa.array([], pa.binary()), np.zeros(0, dtype=np.int64), 0
        self.ids, self.bounds = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _ask(self, runs: list[bytes]) -> None:
        """Makes the runs known. Words go to the library many in a text, each ending with an id that closes a word."""
        starts = np.cumsum([0, *map(len, runs)])[:-1]
        is_word = np.logical_and.reduceat(_kinds(np.frombuffer(b"".join(runs), dtype=np.uint8)) == LETTER, starts)
        words, others = np.flatnonzero(is_word), np.flatnonzero(~is_word).tolist()
        groups = [words[i : i + JOINED_WORDS].tolist() for i in range(0, len(words), JOINED_WORDS)]
        ids, sizes, order = [], [], []
        for k in range(0, len(groups), ASKED_TEXTS):
            part = groups[k : k + ASKED_TEXTS]
            joined = [b" ".join([runs[i] for i in g]).decode() for g in part]
            for group, found in zip(part, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                got = np.array(found.ids, dtype="<u4")
                ends = np.flatnonzero(self.closes[got]) + 1
                if len(ends) != len(group):
                    others += group
                    continue
                ids.append(got)
                sizes.append(np.diff(ends, prepend=0))
                order += group
        for k in range(0, len(others), ASKED_TEXTS * JOINED_WORDS):
            part = others[k : k + ASKED_TEXTS * JOINED_WORDS]
            found = self.tokenizer.encode_batch_fast([runs[i].decode() for i in part], add_special_tokens=False)
            ids += [np.array(f.ids, dtype="<u4") for f in found]
            sizes.append(np.array([len(f.ids) for f in found], dtype=np.int64))
            order += part
        bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        asked, ends = gather(np.concatenate(ids), bounds, np.argsort(order))
        self.known = pa.concat_arrays([self.known, pa.array(runs, pa.binary())])
        self.met = np.concatenate((self.met, np.full(len(runs), self.slices)))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + ends))
        self.ids = np.concatenate((self.ids, asked))

    def _forget(self) -> None:
        """Keeps the pieces met last, half the bytes, when the known ones have become too many."""
        sizes = np.asarray(pc.binary_length(self.known)) + 4 * np.diff(self.bounds) + 20
        if sizes.sum() <= CACHE_BYTES:
            return
        latest = np.argsort(-self.met, kind="stable")
        kept = np.sort(latest[np.cumsum(sizes[latest]) <= CACHE_BYTES // 2])
        self.known, self.met = self.known.take(pa.array(kept)), self.met[kept]
        self.ids, ends = gather(self.ids, self.bounds, kept)
        self.bounds = np.concatenate(([0], ends))

    def _places(self, runs: pa.Array) -> np.ndarray:
        """Where each of the distinct runs is among the known ones."""
        self._forget()
        self.slices += 1
        at = pc.index_in(runs, value_set=self.known)
        new = runs.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        self.met[at[at >= 0]] = self.slices
        if len(new):
            at[at < 0] = len(self.known) + np.arange(len(new))
            self._ask(new.to_pylist())
        return at

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = pc.match_substring(texts, "<|")
        whole = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        found, bounds = pieces(pc.if_else(special, "", texts))
        spelled = found.dictionary_encode()
        index = self._places(spelled.dictionary)[spelled.indices.to_numpy()]
        flat, offsets = self.ids, self.bounds
        if len(whole):
            extra = self.tokenizer.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)
            extra = [np.array(f.ids, dtype="<u4") for f in extra]
            index = np.insert(index, bounds[whole], len(offsets) - 1 + np.arange(len(whole)))
            sizes = np.diff(bounds)
            sizes[whole] = 1
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            flat = np.concatenate([flat, *extra])
            offsets = np.concatenate((offsets, offsets[-1] + np.cumsum([len(e) for e in extra])))
        ids, ends = gather(flat, offsets, index)
        return ids, np.concatenate(([0], ends))[bounds[1:]]


_LOADED: dict[int, WordTokenizer] = {}


def _tokenizer(sent) -> WordTokenizer:
    spec = sent.value
    key = zlib.crc32(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordTokenizer(spec)
    return _LOADED[key]


def tokenize(spark: SparkSession, docs: DataFrame, end_id: int, key: str, text: str, path: str) -> DataFrame:
    """``key`` and packed ``ids`` of each whole text, ``end_id`` last; and per task a row with its ``counts`` of ids."""
    with open(path, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    fields = [("key", None), ("ids", pa.binary()), ("counts", pa.binary())]
    kind = T.StructType([rows.schema[0], T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, held, keys = _tokenizer(sent), np.zeros(1, dtype=np.int64), None
        for batch in batches:
            for part in slices(batch, "text", 3 * SLICE_BYTES // 2):
                ids, ends = tokenizer.encode_batch(texts_of(part))
                ids = np.insert(ids, ends, np.uint32(end_id))
                held = _added(held, np.bincount(ids, minlength=1))
                bounds = [0, *(ends + np.arange(1, len(ends) + 1)).tolist()]
                packed = [pack(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                keys = part.column(0)
                yield with_output(fields, [keys, packed, [None] * len(packed)])
            pa.default_memory_pool().release_unused()
        if keys is not None:
            yield with_output(fields, [pa.nulls(1, keys.type), [None], [held.astype("<i8").tobytes()]])

    return rows.mapInArrow(run, kind)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(max(len(a), len(b)), dtype=np.int64)
    total[: len(a)] = a
    total[: len(b)] += b
    return total


def pack(ids: np.ndarray) -> bytes:
    """Staged form of a document's ids: their count, their width in bytes, and the ids through a fast coder."""
    width = 4 if len(ids) and ids.max() > 0xFFFF else 2
    return struct.pack("<IB", len(ids), width) + _ZSTD.compress(ids.astype(f"<u{width}").tobytes())


def unpack(packed: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", packed)
    raw = _UNZSTD.decompress(packed[5:], max_output_size=max(1, width * n))
    return np.frombuffer(raw, dtype=f"<u{width}").astype(np.uint32)


def global_counts(encoded: DataFrame) -> np.ndarray:
    """Occurrences of every id, from one row of counts per task; the driver gets a row per vocabulary id."""

    def run(batches):
        held = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                held = _added(held, np.frombuffer(counts, dtype="<i8"))
        at = np.flatnonzero(held)
        yield with_output([("id", pa.int64()), ("n", pa.int64())], [at, held[at]])

    rows = encoded.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long")
    found = rows.groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r.id] = r.n
    return counts


class _Writer:
    """Writes one file block by block; nothing but footers stays in memory."""

    def __init__(self, folder: str, lengths: np.ndarray) -> None:
        self.system, root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(root, recursive=True)
        self.path = f"{root}/ids-{uuid.uuid4().hex}.bin"  # attempts never share a name; the manifest names the kept one
        self.stream = self.system.open_output_stream(self.path, compression=None)
        self.stream.write(MAGIC)
        self.size = len(MAGIC)
        self.lengths, self.codes = lengths, huffman.canonical_codes(lengths)
        self.offsets, self.counts, self.documents, self.keys, self.n_ids = [], [], [], [], 0

    def add(self, keys: pa.Array, documents: list[np.ndarray]) -> None:
        self.keys.append(keys)
        ids = np.concatenate(documents)
        for k in range(0, len(ids), RUN_IDS):
            run = ids[k : k + RUN_IDS]
            coded, offsets = huffman.encode(run, self.lengths, self.codes)
            self.offsets.append(offsets + 8 * self.size)
            sizes = np.full(len(offsets), huffman.BLOCK_IDS, dtype=np.uint32)
            sizes[-1] = len(run) - huffman.BLOCK_IDS * (len(offsets) - 1)
            self.counts.append(sizes)
            self.stream.write(coded)
            self.size += len(coded)
        self.documents.append(np.array([len(d) for d in documents], dtype=np.int64))
        self.n_ids += len(ids)

    def close(self) -> None:
        documents, offsets, counts = (np.concatenate(x) for x in (self.documents, self.offsets, self.counts))
        keys = pa.concat_arrays(self.keys)
        footer = {"documents": len(documents), "blocks": len(offsets), "vocabulary": len(self.lengths), "ids": self.n_ids}
        tail = np.asarray(pc.fill_null(keys, 0), dtype="<i8").tobytes() + np.asarray(pc.is_valid(keys), dtype="u1").tobytes()
        tail += documents.astype("<i8").tobytes() + offsets.astype("<i8").tobytes() + counts.astype("<u4").tobytes()
        tail += self.lengths.tobytes()
        note = json.dumps(footer | {"tail": len(tail)}).encode()
        self.stream.write(tail + note + struct.pack("<I", len(note)) + MAGIC)
        self.stream.close()


def write(spark: SparkSession, encoded: DataFrame, counts: np.ndarray, folder: str) -> DataFrame:
    """Writes the ids in ascending key order; returns the manifest, one row per file: part, path, ids, size."""
    sent = spark.sparkContext.broadcast(huffman.code_lengths(counts))

    def run(batches):
        from pyspark import TaskContext

        writer = None
        for batch in batches:
            for part in slices(batch, "ids", SLICE_BYTES // 2):
                writer = writer or _Writer(folder, sent.value)
                writer.add(part.column(0).cast(pa.int64()), [unpack(p) for p in part.column(1).to_pylist()])
        if writer:
            writer.close()
            rows = [TaskContext.get().partitionId()], [writer.path], [writer.n_ids], [writer.size]
            yield with_output([("part", pa.int32()), ("path", pa.string()), ("ids", pa.int64()), ("size", pa.int64())], [*rows])

    ordered = encoded.where("ids IS NOT NULL").select("key", "ids").repartitionByRange(F.col("key").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("key").asc_nulls_first(), "ids")
    return ordered.mapInArrow(run, "part int, path string, ids long, size long")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``key``, ``start`` (ids of all documents before) and ``ids`` of every document, decoded from the files."""
    return _read(spark, manifest, "ids array<int>", lambda spans: pa.array([s.astype(np.int32) for s in spans], pa.list_(pa.int32())))


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """As ``read``, with ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian 32-bit integers) for the ids."""
    crc = lambda spans: pa.array([zlib.crc32(s.astype("<u4", copy=False).tobytes()) for s in spans], pa.int64())
    return _read(spark, manifest, "ids_crc32 long", crc)


def _read(spark: SparkSession, manifest: DataFrame, field: str, emit) -> DataFrame:
    files = sorted(manifest.collect(), key=lambda r: r.part)  # one row per file
    start, listed = 0, []
    for f in files:
        listed.append((f.path, start))
        start += f.ids
    schema = f"key long, start long, n_tokens long, {field}"
    if not listed:
        return spark.createDataFrame([], schema)
    given = spark.createDataFrame(listed, "path string, start long").repartition(len(listed))

    def run(batches):
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for keys, starts, sizes, spans in read_file(path):
                    fields = [("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (field.split()[0], None)]
                    yield with_output(fields, [keys, start + starts, sizes, emit(spans)])

    return given.mapInArrow(run, schema)


def read_file(path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Keys, starts, lengths and ids of the documents of one file, some whole documents at a time."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(name) as file:
        size = file.size()
        ending = file.read_at(len(MAGIC) + 4, size - len(MAGIC) - 4)
        if file.read_at(len(MAGIC), 0) != MAGIC or ending[4:] != MAGIC:
            raise ValueError(f"not a token-id file: {path}")
        (n,) = struct.unpack("<I", ending[:4])
        at = size - len(ending) - n
        note = json.loads(file.read_at(n, at))
        tail = file.read_at(note["tail"], at - note["tail"])
        coded_end = at - note["tail"]
        documents, blocks = note["documents"], note["blocks"]
        parts, k = [], 0
        for kind, count in (("<i8", documents), ("u1", documents), ("<i8", documents), ("<i8", blocks), ("<u4", blocks), ("u1", note["vocabulary"])):
            parts.append(np.frombuffer(tail, dtype=kind, count=count, offset=k))
            k += parts[-1].nbytes
        keys, valid, sizes, offsets, counts, lengths = parts
        table = huffman.decode_table(lengths)
        ends, block_ends = np.cumsum(sizes), np.cumsum(counts.astype(np.int64))
        first = 0
        while first < documents:
            begin = int(ends[first] - sizes[first])
            last = max(first + 1, int(np.searchsorted(ends, begin + READ_IDS, side="right")))
            stop = int(ends[last - 1])
            a = int(np.searchsorted(block_ends, begin, side="right"))
            b = int(np.searchsorted(block_ends, stop, side="left")) + 1
            from_byte = int(offsets[a]) >> 3
            to_byte = min(coded_end, (int(offsets[b]) >> 3) + 1) if b < blocks else coded_end
            stream = file.read_at(to_byte - from_byte, from_byte)
            ids = huffman.decode(stream, offsets[a:b] - 8 * from_byte, counts[a:b].astype(np.int64), table)
            skip = begin - (int(block_ends[a - 1]) if a else 0)
            cuts = skip + ends[first:last] - begin
            spans = [ids[c - s : c] for c, s in zip(cuts.tolist(), sizes[first:last].tolist(), strict=True)]
            given = pa.array(keys[first:last], mask=valid[first:last] == 0)
            yield given, ends[first:last] - sizes[first:last], sizes[first:last], spans
            first = last


def write_corpus(
    spark: SparkSession, docs: DataFrame, end_id: int = 1, key: str = "doc_id", text: str = "text",
    path: str | None = None, folder: str | None = None,
) -> DataFrame:
    """Encodes, counts, and writes all texts below ``folder``; returns the stored manifest."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    folder = folder or work_dir(spark, "idfiles")
    encoded = materialize(tokenize(spark, docs, end_id, key, text, path), spark, "encoded")
    return materialize(write(spark, encoded, global_counts(encoded), folder), spark, "manifest")
