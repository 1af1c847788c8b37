"""Many texts as one array of code points, with their letters, words and sentences found by array operations."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import regex

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
SENTENCE_ENDS = ".!?\n\r…。！？"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case letter (0 for what is no letter), and whether it ends a sentence."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for found in regex.finditer(r"\p{L}", "".join(map(chr, points))):
        letter = found.group()
        small = letter.lower()
        lower[ord(letter)] = ord(small) if len(small) == 1 else ord(letter)
    ends = np.zeros(0x110000, dtype=bool)
    ends[[ord(c) for c in SENTENCE_ENDS]] = True
    return lower, ends


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a line end before each and after the last, and where each text starts."""
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return points, starts


def letters(points: np.ndarray) -> np.ndarray:
    return _tables()[0][points]


def words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters: where each starts and ends, and a 64-bit hash of its lower-case spelling."""
    lower = letters(points)
    inside = np.concatenate(([False], lower > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, spelling(points, starts, ends)


def spelling(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the lower-case letters of each span, wherever it stands."""
    lower = letters(points).astype(np.uint64)
    found = np.zeros(len(starts), dtype=np.uint64)
    size = ends - starts
    for k in range(int(size.max(initial=0))):
        if k == 64:  # the rare longer ones one by one
            for i in np.flatnonzero(size > k).tolist():
                rest = lower[starts[i] + k : ends[i]].tobytes()
                found[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(rest, digest_size=8).digest(), "little"))
            break
        more = size > k if k else slice(None)
        at = starts[more] + k
        found[more] = (found[more] ^ lower[at]) * _PRIME
    return found ^ (found >> np.uint64(32))


def sentences(points: np.ndarray) -> np.ndarray:
    """For each place the number of the sentence it is in; a text's first place always starts a new one."""
    return np.cumsum(_tables()[1][points])


def subwords(points: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of letters of the given sizes, word edges included as a symbol: places and buckets."""
    symbol = letters(points).astype(np.uint64)
    letter = symbol > 0
    places, found = [], []
    for size in sizes:
        n = len(symbol) - size + 1
        if n <= 0:
            continue
        value = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            value = (value ^ symbol[k : k + n]) * _PRIME
        value ^= value >> np.uint64(29)
        keep = letter[:n] | letter[size - 1 :]
        for k in range(1, size - 1):
            keep &= letter[k : k + n]
        at = np.flatnonzero(keep)
        places.append(at)
        found.append((value[at] * _PRIME >> np.uint64(40)).astype(np.int64) % buckets)
    return np.concatenate(places), np.concatenate(found)
