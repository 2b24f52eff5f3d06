"""Keywords of documents: plain top n, maximal sum of distances, maximal marginal relevance.

Candidates are runs of one or two words without English stop words. All three
rankings are worked out where a text lies, in Arrow batches: counts and, for the
two that weigh candidates against each other, hashed word vectors. Counts and
maximal sums take many texts at once; there is no shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations
from math import comb
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import small_batches

TOP, LEAST_CHARS, CANDIDATES, DIVERSITY = 5, 10, 20, 0.7
#: English words that are no keywords (fixed values).
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was "
    "we were what when where which while who whom why will with you your yours yourself yourselves"
).split()
_STOP = frozenset(STOP_WORDS)
_WORD = re.compile("[a-z0-9]{2,}")
_DIMENSIONS = 512  # nine bits of an entry of _word
#: Pairs of words whose vectors are held at a time.
_BLOCK = 4096
#: Texts whose candidates are taken together, and matrices of candidates compared at a time.
_TEXTS, _MATRICES = 256, 32


def top_keywords(docs: DataFrame, key: str, text: str, top: int = TOP) -> DataFrame:
    """(key, keyword, n, rank): the most frequent candidates of each text, in alphabetical order of equals; counted where the text lies."""
    small_batches(docs.sparkSession)
    found = docs.select(key, F.posexplode(frequent_udf(top)(text)).alias("_k", "_x"))
    return found.select(key, F.col("_x.keyword").alias("keyword"), F.col("_x.n").alias("n"), (F.col("_k") + 1).alias("rank"))


@lru_cache(maxsize=1 << 17)
def _word(word: str) -> bytes:
    """A word's hashed runs of three and four characters: value << 9 | place in 8 bytes, each place once."""
    padded = f"<{word}>".encode()
    hashes = [crc32(padded[k : k + n]) for n in (3, 4) for k in range(len(padded) - n + 1)]
    places = [h % _DIMENSIONS for h in hashes]
    if len(set(places)) == len(places):
        return np.array([p | 512 if h >> 16 & 1 else p - 512 for h, p in zip(hashes, places, strict=True)], np.int64).tobytes()
    out = dict.fromkeys(places, 0)
    for h, p in zip(hashes, places, strict=True):
        out[p] += 1 if h >> 16 & 1 else -1
    return np.array([v << 9 | p for p, v in out.items()], np.int64).tobytes()


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values."""
    entries = np.frombuffer(packed, np.int64)
    return entries & _DIMENSIONS - 1, (entries >> 9).astype(np.float64)


class _Phrases:
    """A text's candidates. A phrase's vector is the sum of its words' over its length, so only words have vectors, sparse ones."""

    def __init__(self, text: str):
        words = [w for w in _WORD.findall(text.lower()) if w not in _STOP]
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        ids = np.array([number[w] for w in words], np.int64)
        self.words, n = list(number), len(number)
        vectors = [_word(w) for w in self.words]
        self.size = np.array([len(v) // 8 for v in vectors], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.place, self.value = _unpacked(b"".join(vectors))
        self.row = np.repeat(np.arange(n), self.size)
        pairs = np.unique(ids[:-1] * n + ids[1:])
        self.first, self.second = np.concatenate([np.arange(n), pairs // max(n, 1)]), np.concatenate([np.full(n, -1), pairs % max(n, 1)])
        squares = np.bincount(self.row, self.value**2, n)
        a, b = self.first[n:], self.second[n:]
        both = squares[a] + squares[b] + 2 * np.concatenate([np.zeros(0), *[self._products(a[k : k + _BLOCK], b[k : k + _BLOCK]) for k in range(0, len(a), _BLOCK)]])
        length = np.sqrt(np.concatenate([squares, both]))
        self.length = np.where(length > 0, length, 1.0)
        whole = np.bincount(self.place, self.value * np.bincount(ids, minlength=n)[self.row], _DIMENSIONS)
        self.near = self.alike(whole / (np.linalg.norm(whole) or 1))

    def _entries(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word given: which it is, and where its places and values are."""
        size = self.size[words]
        return np.repeat(np.arange(len(words)), size), np.arange(size.sum()) + np.repeat(self.start[words] - (np.cumsum(size) - size), size)

    def _products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        used, at = np.unique(b, return_inverse=True)
        dense = np.zeros((len(used), _DIMENSIONS))
        row, entry = self._entries(used)
        dense[row, self.place[entry]] = self.value[entry]
        row, entry = self._entries(a)
        return np.bincount(row, self.value[entry] * dense[at[row], self.place[entry]], len(a))

    def __len__(self) -> int:
        return len(self.first)

    def alike(self, vector: np.ndarray) -> np.ndarray:
        """Cosines of all phrases to a vector of length 1."""
        of = np.bincount(self.row, self.value * vector[self.place], len(self.words))
        return (of[self.first] + np.where(self.second >= 0, of[self.second], 0.0)) / self.length if len(self) else np.zeros(0)

    def vector(self, k: int) -> np.ndarray:
        out = np.zeros(_DIMENSIONS)
        for w in (self.first[k], self.second[k]):
            if w >= 0:
                place, value = _unpacked(_word(self.words[w]))
                out[place] += value
        return out / self.length[k]

    def name(self, k: int) -> str:
        return self.words[self.first[k]] + (f" {self.words[self.second[k]]}" if self.second[k] >= 0 else "")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _word_vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, value) of the entries of all words' vectors, in order of words; as :func:`_word` has them one by one."""
    data = np.frombuffer(("<" + "><".join(words) + ">").encode() if words else b"", np.uint8)
    ends = np.cumsum([len(w) + 2 for w in words])
    of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    state, keys = np.full(len(data), 0xFFFFFFFF, np.uint32), []
    for n in range(1, 5):
        state = _CRC[(state[: len(data) - n + 1] ^ data[n - 1 :]) & 255] ^ state[: len(data) - n + 1] >> np.uint32(8)
        if n > 2:
            fits = np.flatnonzero(np.arange(len(state)) + n <= ends[of[: len(state)]])
            h = ~state[fits]
            keys.append((of[fits] * _DIMENSIONS + (h & np.uint32(_DIMENSIONS - 1))) * 2 + (h >> np.uint32(16) & 1))
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    ranked = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.diff(ranked >> 1, prepend=-1))
    return ranked[first] // 2 // _DIMENSIONS, ranked[first] // 2 % _DIMENSIONS, np.add.reduceat(2.0 * (ranked & 1) - 1.0, first)


class _Texts:
    """The candidates of several texts at once: words and pairs of words, each once a text, with how often they occur."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        ids, sizes = [], []
        for text in texts:
            own = [number.setdefault(w, len(number)) for w in _WORD.findall(text.lower()) if w not in _STOP]
            ids += own
            sizes.append(len(own))
        self.count, self.words, self.n = len(texts), list(number), max(1, len(number))
        ids, of = np.array(ids, np.int64), np.repeat(np.arange(len(texts)), sizes)
        self.single, singly = np.unique(of * self.n + ids, return_counts=True)
        same = np.flatnonzero(of[1:] == of[:-1])
        # Of a text by its number, a pair by its first word's place among all singles, which has the text in it, and its second word.
        begun = np.searchsorted(self.single, of[same] * self.n + ids[same])
        pairs, doubly = np.unique(begun * self.n + ids[same + 1], return_counts=True)
        begun = self.single[pairs // self.n]
        self.of = np.concatenate([self.single, begun]) // self.n
        self.first = np.concatenate([self.single, begun]) % self.n
        self.second = np.concatenate([np.full(len(self.single), -1), pairs % self.n])
        self.often = np.concatenate([singly, doubly])
        rank = np.empty(self.n, np.int64)
        rank[np.argsort(np.array([*self.words, *[""] * (self.n - len(self.words))]), kind="stable")] = np.arange(self.n)
        # A space goes before all letters, so names are in the order of their words.
        self.alphabet = [np.where(self.second >= 0, rank[self.second], -1), rank[self.first]]

    def best(self, worth: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the ``most`` candidates of greatest worth (whole numbers), then in alphabetical order, and how many a text has."""
        keys = self.of << 33 | (1 << 32) - worth
        ranked = np.sort(keys)
        first = np.searchsorted(ranked, np.arange(self.count + 1) << 33)
        last = np.minimum(first[:-1] + most, first[1:]) - 1  # the least that may stay, with its equals
        some = np.flatnonzero(keys <= np.where(last >= 0, ranked[last], -1)[self.of]) if len(keys) else np.empty(0, np.int64)
        order = some[np.lexsort((*[a[some] for a in self.alphabet], keys[some]))]
        of = self.of[order]
        kept = order[np.arange(len(of)) - np.searchsorted(of, of) < most]
        return kept, np.bincount(self.of[kept], minlength=self.count)

    def name(self, k: int) -> str:
        return self.words[self.first[k]] + (f" {self.words[self.second[k]]}" if self.second[k] >= 0 else "")

    def vectors(self) -> None:
        """Lengths of the candidates, and ``near``: their cosines to their texts."""
        row, place, value = _word_vectors(self.words)
        size = np.bincount(row, minlength=self.n)
        self.dense = np.zeros((self.n + 1, _DIMENSIONS), np.float32)  # the last row, which -1 means, stays 0
        self.dense[row, place] = value
        start, squares = np.cumsum(size) - size, np.bincount(row, value**2, self.n)
        one = len(self.single)

        def entries(words):
            own = size[words]
            return np.repeat(np.arange(len(words)), own), np.arange(own.sum()) + np.repeat(start[words] - (np.cumsum(own) - own), own)

        row, at = entries(self.first[:one])
        whole = np.bincount(self.of[row] * _DIMENSIONS + place[at], value[at] * self.often[row], self.count * _DIMENSIONS).astype(np.float64).reshape(-1, _DIMENSIONS)  # whole numbers if there is nothing
        whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
        dots = np.bincount(row, value[at] * whole[self.of[row], place[at]], one)
        a, b, of = self.first[one:], self.second[one:], self.of[one:]
        row, at = entries(a)
        product = np.bincount(row, value[at] * self.dense[b[row], place[at]], len(a))
        length = np.sqrt(np.concatenate([squares[self.first[:one]], squares[a] + squares[b] + 2 * product]))
        self.length = np.where(length > 0, length, 1.0)
        pair_dots = dots[np.searchsorted(self.single, of * self.n + a)] + dots[np.searchsorted(self.single, of * self.n + b)]
        self.near = np.concatenate([dots, pair_dots]) / self.length


@lru_cache(maxsize=64)
def _prefixes(n: int, size: int) -> np.ndarray:
    """All sets of ``size`` of ``n`` by their last numbers, so that those below any number come first."""
    return np.array(sorted(combinations(range(n), size), key=lambda c: c[::-1])).reshape(-1, size)


@lru_cache(maxsize=64)
def _grown(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set of ``size`` in the order of ``_prefixes``: which set it is without its last number, and that number."""
    last = np.repeat(np.arange(n), [comb(c, size - 1) for c in range(n)])
    return np.concatenate([np.arange(comb(c, size - 1)) for c in range(n)]), last


def _least_alike(alike: np.ndarray, top: int) -> list[tuple[int, ...]]:
    """Of each matrix, the set of ``top`` rows with the least sum of pairs (rounded); of equals the first in order.

    Sets grow by their last row: ``own`` has the sums of all sets so far, in the
    order of ``_prefixes``, in which those below a row come first, and ``more``
    these sets' sums with it, so no set's pairs are added up one by one.
    """
    n = alike.shape[1]
    if top < 3:
        sets = list(combinations(range(n), top))
        return [min(sets, key=lambda c: (round(float(sum(m[x, y] for x, y in combinations(c, 2))), 9), c)) for m in alike]
    alike = np.ascontiguousarray(alike.transpose(1, 2, 0))  # a set's sums of all matrices lie side by side
    own = np.zeros((n, alike.shape[2]))
    more = [alike[c, :c] for c in range(n)]  # of each row, its sums with the sets below it
    for size in range(1, top - 2):
        below = [comb(c, size) for c in range(size, n)]
        own = np.concatenate([own[:p] + more[c][:p] for c, p in enumerate(below, size)])
        rest, last = _grown(n, size + 1)
        more = [more[c][rest[: comb(c, size + 1)]] + alike[c, last[: comb(c, size + 1)]] for c in range(n)]
    pairs, lows = [], []  # a set's two last rows, and the least sum of the sets that have them
    for d in range(top - 2, n - 1):
        p = comb(d, top - 2)
        begun = own[:p] + more[d][:p]
        for e in range(d + 1, n):
            pairs.append((d, e))
            lows.append((begun + more[e][:p]).min(axis=0) + alike[d, e])
    lows = np.stack(lows).round(9)
    sets, out = _prefixes(n, top - 2), []
    for k, least in enumerate(lows.min(axis=0)):
        found = []
        for q in np.flatnonzero(lows[:, k] == least):
            d, e = pairs[q]
            p = comb(d, top - 2)
            sums = own[:p, k] + more[d][:p, k] + more[e][:p, k] + alike[d, e, k]
            found += [(*sets[x].tolist(), d, e) for x in np.flatnonzero(sums.round(9) == least)]
        out.append(min(found))
    return out


def max_sums(texts: list[str], top: int = TOP, most: int = CANDIDATES) -> list[list[str]]:
    """Of each text's nearest candidates, those least alike each other."""
    out: list[list[str]] = []
    for a in range(0, len(texts), _TEXTS):
        own = _Texts(texts[a : a + _TEXTS])
        own.vectors()
        kept, sizes = own.best(np.rint(own.near * 1e9).astype(np.int64), most)
        ends = np.cumsum(sizes)
        chosen = [kept[e - m : e] for e, m in zip(ends, sizes, strict=True)]
        for m in np.unique(sizes[sizes > top]):
            same = np.flatnonzero(sizes == m)
            for b in range(0, len(same), _MATRICES):
                part = same[b : b + _MATRICES]
                rows = np.stack([chosen[k] for k in part])
                vectors = own.dense[own.first[rows]] + own.dense[own.second[rows]]
                alike = (vectors @ vectors.transpose(0, 2, 1)).astype(np.float64)  # of whole numbers, so exact until here
                alike /= own.length[rows][:, :, None] * own.length[rows][:, None, :]
                for k, best in zip(part, _least_alike(alike, top), strict=True):
                    chosen[k] = chosen[k][list(best)]
        out += [[own.name(k) for k in c] for c in chosen]
    return out


def max_sum(text: str, top: int = TOP, most: int = CANDIDATES) -> list[str]:
    return max_sums([text], top, most)[0]


def frequent(texts: list[str], top: int = TOP) -> list[list[tuple[str, int]]]:
    """The most frequent candidates of each text and how often they occur, in alphabetical order of equals."""
    out = []
    for a in range(0, len(texts), _TEXTS):
        own = _Texts(texts[a : a + _TEXTS])
        kept, sizes = own.best(own.often, top)
        ends = np.cumsum(sizes)
        out += [[(own.name(k), int(own.often[k])) for k in kept[e - m : e]] for e, m in zip(ends, sizes, strict=True)]
    return out


def marginal(text: str, top: int = TOP, diversity: float = DIVERSITY) -> list[str]:
    """One candidate after another, near to the text and far from those taken (Carbonell and Goldstein 1998)."""
    phrases = _Phrases(text)
    taken: list[int] = []
    close = np.zeros(len(phrases))
    near = np.round(phrases.near, 9)
    while len(taken) < min(top, len(phrases)):
        worth = np.round((1 - diversity) * phrases.near - diversity * close, 9)
        worth[taken] = -np.inf
        best = min(np.flatnonzero(worth == worth.max()).tolist(), key=lambda k: (-near[k], phrases.name(k)))
        alike = phrases.alike(phrases.vector(best))
        close = np.maximum(close, alike) if taken else alike
        taken.append(best)
    return [phrases.name(k) for k in taken]


class Failed(list):
    """What a text that can't be ranked has in place of keywords: nothing, and why. The UDFs hand it on as an error, never as an empty list."""

    def __init__(self, error: Exception):
        super().__init__()
        self.error = f"{type(error).__name__}: {error}"


def _each(c: pd.Series, pick_all) -> pd.Series:
    """``pick_all`` of the texts that are long enough, nothing of the others, :class:`Failed` of those it fails on."""
    out: list[list] = [[] for _ in range(len(c))]
    some = [k for k, t in enumerate(c) if t is not None and len(t.strip()) >= LEAST_CHARS]
    texts = [c.iloc[k] for k in some]
    try:
        found = pick_all(texts)
    except Exception:  # one by one, to tell the texts that can't be ranked from the others
        found = []
        for text in texts:
            try:
                found += pick_all([text])
            except Exception as e:
                found.append(Failed(e))
    for k, own in zip(some, found, strict=True):
        out[k] = own
    return pd.Series(out, dtype=object)


def _udf(pick_all, kind: T.DataType | None = None, errors: bool = False):
    """UDF from texts to arrays of ``kind`` (strings).

    A text that can't be ranked ends the job, or, with ``errors``, what is
    returned is a struct of ``keywords``, which are null then, and ``error``.
    """
    found = T.ArrayType(kind or T.StringType())
    if errors:

        @F.pandas_udf(T.StructType([T.StructField("keywords", found), T.StructField("error", T.StringType())]))
        def run_all(c: pd.Series) -> pd.DataFrame:
            each = [(None, x.error) if isinstance(x, Failed) else (x, None) for x in _each(c, pick_all)]
            return pd.DataFrame(each, columns=["keywords", "error"], dtype=object)

        return run_all

    @F.pandas_udf(found)
    def run(c: pd.Series) -> pd.Series:
        out = _each(c, pick_all)
        failed = [k for k, x in enumerate(out) if isinstance(x, Failed)]
        if failed:
            text = c.iloc[failed[0]]
            raise RuntimeError(f"keywords of {len(failed)} texts of a batch of {len(c)} failed, the first of them of {len(text)} characters, {text[:80]!r}: {out.iloc[failed[0]].error}")
        return out

    return run


def max_sum_keywords(top: int = TOP, most: int = CANDIDATES, errors: bool = False):
    return _udf(lambda texts: max_sums(texts, top, most), errors=errors)


def marginal_keywords(top: int = TOP, diversity: float = DIVERSITY, errors: bool = False):
    return _udf(lambda texts: [marginal(t, top, diversity) for t in texts], errors=errors)


def frequent_udf(top: int = TOP):
    """UDF from texts to their most frequent candidates, with n."""
    kind = T.StructType([T.StructField("keyword", T.StringType()), T.StructField("n", T.LongType())])
    return _udf(lambda texts: [[{"keyword": k, "n": n} for k, n in found] for found in frequent(texts, top)], kind)


def extract_keywords(text: Column, mmr: bool = False, maxsum: bool = True, top: int = TOP, errors: bool = False) -> Column:
    """An array of keywords; marginal relevance goes before maximal sums, and the plain ranking is what is left.

    A text that can't be ranked ends the job, or, with ``errors``, there is a struct of ``keywords`` and ``error``.
    """
    if mmr:
        return marginal_keywords(top, errors=errors)(text)
    if maxsum:
        return max_sum_keywords(top, errors=errors)(text)
    return _udf(lambda texts: [[k for k, _ in found] for found in frequent(texts, top)], errors=errors)(text)
