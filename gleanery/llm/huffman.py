"""Canonical length-limited Huffman coding of token ids, in independent blocks with bit-offset checkpoints."""

from __future__ import annotations

import numpy as np

#: Longest code in bits; decoding looks codes up in a table of 2**MAX_BITS entries.
MAX_BITS = 16
#: Ids per block: each block can be decoded from its bit offset alone.
BLOCK_IDS = 1024


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package merging; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if not len(used):
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    single = np.ones(len(leaves), dtype=bool)
    levels.append(single)
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        rank = np.argsort(both, kind="stable")
        row = both[rank]
        levels.append(rank < len(leaves))
    take = 2 * len(leaves) - 2
    found = np.zeros(len(leaves), dtype=np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        found[:n] += 1
        take = 2 * (take - n)
    lengths[order] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the canonical order: by length, then by id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, previous = 0, 0
    steps = lengths[order].tolist()
    out = np.zeros(len(order), dtype=np.uint64)
    for i, bits in enumerate(steps):
        code <<= bits - previous
        out[i] = code
        code, previous = code + 1, bits
    codes[order] = out
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``limit`` bits: the id that it starts with, and how many bits that id takes."""
    ids = np.zeros(1 << limit, dtype=np.uint32)
    bits = np.ones(1 << limit, dtype=np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    total = int(spans.sum())
    ids[:total] = np.repeat(order, spans)
    bits[:total] = np.repeat(lengths[order].astype(np.int64), spans)
    return ids, bits


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream (first bit highest, padded to whole bytes) and the bit offset of every block."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.int64)
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    word = starts >> 5
    shift = (64 - bits - (starts & 31)).astype(np.uint64)
    value = codes[ids] << shift
    stream = np.zeros(int(word[-1]) + 2, dtype=np.uint32)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    at = word[first]
    stream[at] = np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), first)
    stream[at + 1] |= np.bitwise_or.reduceat((value & np.uint64(0xFFFFFFFF)).astype(np.uint32), first)
    return stream.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::BLOCK_IDS]


def decode(stream: bytes, offsets: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of the blocks at the given bit offsets; all blocks advance together, one id a step."""
    out = np.zeros(int(counts.sum()), dtype=np.uint32)
    if not len(out):
        return out
    data = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8)
    limit = len(table[0]).bit_length() - 1
    order = np.argsort(-counts, kind="stable")
    position, left = offsets[order].astype(np.int64), counts[order]
    to = (np.cumsum(counts) - counts)[order]
    mask = (1 << limit) - 1
    live = len(order)
    for step in range(int(left[0])):
        while left[live - 1] <= step:
            live -= 1
        p = position[:live]
        at = p >> 3
        window = (data[at].astype(np.int64) << 16) | (data[at + 1].astype(np.int64) << 8) | data[at + 2]
        code = (window >> (24 - limit - (p & 7))) & mask
        out[to[:live] + step] = table[0][code]
        position[:live] = p + table[1][code]
    return out
