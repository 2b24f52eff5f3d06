"""Vectorised words and word hashes of UTF-8 text.

Every character from U+0080 on consists of bytes from 0x80 on, so classes of
ASCII characters can be told apart byte by byte.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Of a word's bytes packed in an integer, those that belong to it.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one.
SHORT = 16

#: True for the bytes that separate words of ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII letters and digits, and all from 0x80 on, make words; the rest separates.
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: For bytes.translate: lower-case A-Z, separators of MARKS become spaces.
NORMAL = bytes(0x20 if MARKS[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): the texts' words, of text i those in first[i]:first[i+1]."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    word = ~separators[data]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    at = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return data, starts, ends, np.searchsorted(starts, at)


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and second eight bytes of each word data[start:end] as integers, and the words' lengths; words of up to SHORT bytes are equal when these are."""
    own = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    size = ends - starts
    eight = np.ndarray((len(own) - 7,), "<u8", own, strides=(1,))
    return eight[starts] & _MASK[np.minimum(size, 8)], eight[starts + 8] & _MASK[np.clip(size - 8, 0, 8)], size


def word_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word that do not depend on each other.

    Each step is a permutation of 64 bits between two additions, so no family of
    words is known to collide; longer words take both halves of their xxh3-128.
    """
    low, high, size = packed(data, starts, ends)
    length = size.astype(np.uint64) * _ODD
    one = mix(mix(low ^ np.uint64(0x2545F4914F6CDD1D)) + high) ^ length
    two = mix(mix(high + np.uint64(0x8CB92BA72F3D8DD7)) ^ low) + length
    one, two = mix(one), mix(two)
    for k in np.flatnonzero(size > SHORT):
        whole = xxhash.xxh3_128_intdigest(data[starts[k] : ends[k]].tobytes(), seed=1)
        one[k], two[k] = whole & 0xFFFFFFFFFFFFFFFF, whole >> 64
    return one, two


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]."""
    return word_lanes(data, starts, ends)[0]


def window_hashes(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive word hashes (by doubling, mixed at each step)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total, done, run, size, left = np.full(n, seed, dtype=np.uint64), 0, words, 1, length
    while left:
        if left & 1:
            total = mix(total * _ODD + run[done : done + n])
            done += size
        left >>= 1
        if left:
            run = mix(run[:-size] * _ODD + run[size:])
            size *= 2
    return total


def exact_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words alone: words are compared by their bytes."""
    low, high, size = packed(data, starts, ends)
    long: dict[bytes, int] = {}
    for k in np.flatnonzero(size > SHORT):
        low[k], high[k], size[k] = long.setdefault(data[starts[k] : ends[k]].tobytes(), len(long)), 0, SHORT + 1
    _, low = np.unique(low, return_inverse=True)
    _, high = np.unique(high, return_inverse=True)
    # Both are below the number of words, so that the three fit in 64 bits.
    whole = (low.astype(np.uint64) << np.uint64(29) | high.astype(np.uint64)) * np.uint64(SHORT + 2) + size.astype(np.uint64)
    return np.unique(whole, return_inverse=True)[1]


def exact_runs(codes: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of ``length`` consecutive codes, equal for equal runs alone."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    total, done, run, size, left = np.zeros(n, dtype=np.int64), 0, codes, 1, length

    def pairs(a, b):
        return np.unique(a.astype(np.int64) << 31 | b, return_inverse=True)[1]

    while left:
        if left & 1:
            total = pairs(total, run[done : done + n]) if done else run[:n]
            done += size
        left >>= 1
        if left:
            run = pairs(run[:-size], run[size:])
            size *= 2
    return total
