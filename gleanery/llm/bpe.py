"""Byte-level BPE encoding and decoding by replaying merges over a whole set of words at once.

Texts are cut by the tokenizer's pattern. All distinct words of a slice that the task has not met yet are laid
out in one symbol array with an inverted index from merge rank to the positions where that pair stands. Ranks
are applied in order; each application rewrites its positions and only their two neighbours enter the index.
Words of more than ``LONG_WORD`` bytes are merged by themselves, in the same order of ranks and positions.

Defined results: a NULL text is the empty text and has no ids; rows are independent, so repeated rows repeat
their result; texts of any length are encoded whole, in runs cut where the pattern always cuts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import SLICE_BYTES, Remembered, gather, slices, texts_of, tidy, with_output

#: Bytes from which a word is merged by itself, since many places of one rank would each cost a pass.
LONG_WORD = 2_000
#: Words kept per Python worker and generation, and words laid out at a time; both only bound memory.
CACHE_WORDS = 30_000
REPLAY_WORDS = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _unicode_pattern(pattern: str) -> str:
    """White space as the property of that name, which is what the tokenizer's own engine takes ``\\s`` for."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def pairs_of(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every two tokens that make a third, as sorted keys, and the rank of the third; a key that none has ends them."""
    pairs = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            x, y = ranks.get(token[:k]), ranks.get(token[k:])
            if x is not None and y is not None:
                pairs[x << 32 | y] = rank
    keys = sorted(pairs)
    return np.array([*keys, 1 << 62], dtype=np.int64), np.array([*(pairs[k] for k in keys), -1], dtype=np.int64)


class ByteBpe:
    def __init__(
        self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN,
        pairs: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(_unicode_pattern(pattern))
        self.cut = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pair_keys, self.pair_ranks = pairs or pairs_of(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.first = np.array(
            [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int64
        )
        self.words = Remembered(CACHE_WORDS)
        self.chunks = Remembered(CACHE_WORDS)

    def forget(self) -> None:
        self.words.forget()
        self.chunks.forget()

    def replay(self, words: list[bytes]) -> tuple[bytes, list[int]]:
        """Ids of all words as little-endian 32-bit integers, and where each word's ids end (in bytes).

        One pass over the ranks serves all words. A rank is applied to the leftmost position of each word that
        holds it; further positions of that word go back under the same rank, so that a lower rank which the
        merge has brought about comes first, as it does when words are merged one by one.
        """
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(data)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        ends = np.cumsum(sizes)
        symbol = self.single[data].astype(np.int32)
        alive = np.ones(n, dtype=bool)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        filled = ends[sizes > 0]
        nxt[filled - 1] = -1
        prv[filled - sizes[sizes > 0]] = -1
        held = np.full(n, -1, dtype=np.int32)  # rank of the pair that starts here
        open_ = np.flatnonzero(nxt >= 0)
        held[open_] = self.first[data[open_].astype(np.int64) * 256 + data[open_ + 1]]
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(ranks: np.ndarray, positions: np.ndarray) -> None:
            use = ranks >= 0
            if not use.any():
                return
            ranks, positions = ranks[use], positions[use]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
                r = int(ranks[start])
                if r in index:
                    index[r].append(positions[start:stop])
                else:
                    index[r] = [positions[start:stop]]
                    heappush(heap, r)

        post(held, np.arange(n, dtype=np.int32))
        while heap:
            r = heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[held[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                of = word[at]
                leftmost = np.ones(len(at), dtype=bool)
                leftmost[1:] = of[1:] != of[:-1]
                if not leftmost.all():
                    index[r] = [at[~leftmost]]
                    heappush(heap, r)
                    at = at[leftmost]
            gone = nxt[at]
            after = nxt[gone]
            symbol[at] = r
            nxt[at] = after
            alive[gone] = False
            held[gone] = -1
            right = after >= 0
            held[at] = -1
            x, y = at[right], after[right]
            prv[y] = x
            back = prv[at]
            left = back >= 0
            b = back[left]
            keys = np.concatenate((r << 32 | symbol[y].astype(np.int64), symbol[b].astype(np.int64) << 32 | r))
            found = np.searchsorted(self.pair_keys, keys)
            made = np.where(self.pair_keys[found] == keys, self.pair_ranks[found], -1)
            places = np.concatenate((x, b))
            held[places] = made
            post(made, places)
        kept = np.cumsum(alive)
        out = symbol[alive].astype("<u4").tobytes()
        last = np.where(ends > 0, kept[np.maximum(ends, 1) - 1], 0) if n else ends
        return out, (last * 4).tolist()

    def merged(self, raw: bytes) -> bytes:
        """Ids of one long word: the places of its pairs in a heap by rank and position, over linked symbols."""
        ranks, token = self.ranks, [raw[i : i + 1] for i in range(len(raw))]
        n = len(token)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        held = [ranks.get(token[i] + token[i + 1], -1) for i in range(n - 1)] + [-1]
        heap = [r << 40 | i for i, r in enumerate(held) if r >= 0]
        heapify(heap)
        while heap:
            first = heappop(heap)
            i = first & (1 << 40) - 1
            if held[i] != first >> 40:
                continue
            gone = nxt[i]
            after = nxt[gone]
            token[i] += token[gone]
            token[gone], held[gone], held[i] = b"", -1, -1
            nxt[i] = after
            if after < n:
                prv[after] = i
                held[i] = ranks.get(token[i] + token[after], -1)
                if held[i] >= 0:
                    heappush(heap, held[i] << 40 | i)
            back = prv[i]
            if back >= 0:
                held[back] = ranks.get(token[back] + token[i], -1)
                if held[back] >= 0:
                    heappush(heap, held[back] << 40 | back)
        return np.array([ranks[t] for t in token if t], dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        new = []
        for word in words:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.words[word] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_WORD:
                self.words[word] = self.merged(raw)
            else:
                new.append((word, raw))
        for k in range(0, len(new), REPLAY_WORDS):
            part = new[k : k + REPLAY_WORDS]
            ids, ends = self.replay([raw for _, raw in part])
            start = 0
            for (word, _), end in zip(part, ends, strict=True):
                self.words[word] = ids[start:end]
                start = end

    def _encoded(self, pieces: list[list[str]]) -> list[bytes]:
        self._learn(self.words.missing([w for words in pieces for w in words]))
        known = self.words
        return [b"".join([known[w] for w in words]) for words in pieces]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, which the pattern cuts independently of what stands around it."""
        known = self.chunks
        new = known.missing(chunks)
        known.update(zip(new, self._encoded([self.pattern.findall(c) for c in new]), strict=True))
        return [known[c] for c in chunks]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, concatenated, and where each text's ids end."""
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        spelled = parts.flatten().dictionary_encode()
        index = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = bounds - bounds[0]
        chunks = spelled.dictionary.to_pylist()
        # A space before more white space, or at the end, is not always a place where the pattern cuts.
        odd = np.array([not c or c[0].isspace() for c in chunks], dtype=bool)
        heads = bounds[:-1]
        seen = odd[index]
        seen[heads] = False
        plain = np.add.reduceat(seen, heads) == 0 if len(heads) else np.zeros(0, dtype=bool)
        listed = texts.to_pylist() if not plain.all() else None
        first = [chunks[i] for i in index[heads]]
        whole = [] if listed is None else [listed[i] for i in np.flatnonzero(~plain)]
        encoded = self._chunks([*(" " + c for c in chunks), *first])
        encoded += self._encoded([self.pattern.findall(t) for t in whole])
        index[heads] = len(chunks) + np.arange(len(first))
        if whole:
            keep = np.repeat(plain, np.diff(bounds))
            keep[heads] = True
            index[heads[~plain]] = len(chunks) + len(first) + np.arange(len(whole))
            bounds = np.concatenate(([0], np.cumsum(np.add.reduceat(keep, heads))))
            index = index[keep]
        flat = np.frombuffer(b"".join(encoded), dtype="<u4")
        offsets = np.concatenate(([0], np.cumsum([len(e) // 4 for e in encoded])))
        del parts, spelled, chunks, encoded
        ids, ends = gather(flat, offsets, index)
        return ids, ends[bounds[1:] - 1] if len(index) else np.zeros(len(texts), dtype=np.int64)

    def runs(self, text: str, limit: int = SLICE_BYTES) -> Iterator[str]:
        """The text in runs that the pattern treats independently."""
        start = 0
        while len(text) - start > limit:
            found = self.cut.search(text, start + limit)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([self.encode_batch(pa.array([run], pa.string()))[0] for run in self.runs(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_LOADED: dict[int, ByteBpe] = {}


def _bpe(ranks) -> ByteBpe:
    """One instance per worker and vocabulary; its caches live as long as a task."""
    if ranks.id not in _LOADED:
        _LOADED.clear()
        _LOADED[ranks.id] = ByteBpe(*ranks.value)
    return _LOADED[ranks.id]


class _Shipped:
    """A broadcast vocabulary that says which one it is."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> None:
        # The pairs are found on the driver: the dictionary they come from is large, and all workers start at once.
        self.sent = spark.sparkContext.broadcast((ranks, pattern, pairs_of(ranks)))
        self.id = hash((len(ranks), pattern, min(ranks, key=ranks.get), max(ranks, key=ranks.get)))

    @property
    def value(self):
        return self.sent.value


def _each(column: str, shipped: _Shipped, fields, emit: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shipped)
        try:
            for batch in batches:
                for part in slices(batch, column, SLICE_BYTES // 4):
                    texts = texts_of(part, column)
                    if part.num_rows == 1:
                        ids = bpe.encode(texts[0].as_py())
                        ends = np.array([len(ids)])
                    else:
                        ids, ends = bpe.encode_batch(texts)
                    yield with_output(fields, emit(bpe, part, ids, ends))
                tidy()
        finally:
            # The vocabulary stays with the worker; the words met do not, since other stages need their room.
            bpe.forget()
            tidy()

    return run


def encode(
    spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every text. ``path`` is a rank file, read once on the driver."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    shipped = _Shipped(spark, read_ranks(path), pattern)
    rows = docs.select(docs[key], docs[text])
    fields = [(key, None), ("ids", pa.list_(pa.int32()))]

    def emit(_, part, ids, ends):
        offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
        return [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))]

    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>"
    return rows.mapInArrow(_each(text, shipped, fields, emit), schema)


def decode(spark: SparkSession, encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key`` and ``decoded`` (binary) of every ``ids`` array; NULL ids decode to nothing."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    shipped = _Shipped(spark, read_ranks(path), public_tokenizers.PATTERN)

    def run(batches):
        bpe = _bpe(shipped)
        for batch in batches:
            out = [bpe.decode(np.asarray(ids or [], dtype=np.int64)) for ids in batch.column(1).to_pylist()]
            yield with_output([(key, None), ("decoded", pa.binary())], [batch.column(0), out])

    rows = encoded.select(key, "ids")
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, decoded binary")


def round_trip(
    spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Encodes every text, decodes the ids in the same pass; count and digests of both, and the ids if asked."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    shipped = _Shipped(spark, read_ranks(path), public_tokenizers.PATTERN)
    rows = docs.select(docs[key], docs[text])
    fields = [(key, None), ("n_tokens", pa.int64()), *([("ids", None)] if with_ids else [])]
    fields += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def emit(bpe, part, ids, ends):
        bounds = [0, *ends.tolist()]
        spans = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        listed = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else []
        return [
            part.column(0),
            [len(s) for s in spans],
            *listed,
            [hashlib.sha256(s.astype("<u4", copy=False).tobytes()).hexdigest() for s in spans],
            [hashlib.sha256(bpe.decode(s)).hexdigest() for s in spans],
        ]

    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_each(text, shipped, fields, emit), schema)
