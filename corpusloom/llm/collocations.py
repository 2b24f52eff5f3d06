"""Phrase collocations: suffix automata of shards, their counts reduced globally.

A text is lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, and these
at spaces and tabs into words. Each task takes its texts in shards of bounded
size and builds, per language, the generalised suffix automaton of a shard's
pieces, up to ``DEPTH`` words deep: a state is a class of phrases with the same
end positions, its suffix link leads to the longest suffix that ends in more
places, and the number of end positions is the count of all phrases in the
class, so one row leaves the task for each state. Spark expands a state to its
phrases and adds up their counts over all shards.

A phrase occurs no more often than any part of it. So words are counted first,
then the pairs of frequent words, by 64-bit keys, and then, by their words, the
phrases of which all pairs are frequent. A blocked Bloom filter, bounded by
``FILTER_WORDS``, tells tasks which keys are frequent. It, or pairs with one key,
may let a rare part pass for a frequent one, which costs rows, but never the
other way round, so every frequent phrase is counted in full.

A phrase's score is the least over its cuts of ``SCALE * a / (l + r)``, floored.
A phrase lies inside a longer one exactly if a chain of phrases, each a word
longer at one end, leads there, and counts fall along it; so it is enough to
compare a phrase with those one word longer: from each of these the suffix link
(without the first word) and its mirror image (without the last) lead to it.

Defined results: a null text is empty, a null language ``und``; an empty table
has no phrases; repeated rows count each; a very long text is cut between pieces
into several shards, and one piece is held whole; ties of score and count go by
the phrase's bytes. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._shared import binary, read_table, saved, small_batches
from corpusloom.llm._words import exact_codes, mix, spans, word_hashes

DEPTH, LEAST, TOP = 4, 30, 2000
SCALE = 2_000_000
#: A phrase goes if a longer one around it has so many hundredths of its occurrences.
INSIDE = 80
#: Text bytes of one shard.
SHARD_BYTES = 4 << 20
#: 64-bit words of a filter at most (32 MB), and frequent phrases for each word below that.
FILTER_WORDS, PER_WORD = 1 << 22, 4
#: A language's best are found in so many parts first.
SALTS = 64
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x0A]] = True
#: For bytes.translate: A-Z lower, tabs are spaces, what ends a piece is a line feed.
_NORMAL = bytes(0x20 if b == 0x09 else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Automaton:
    """The suffix automaton, ``depth`` words deep, of runs of word codes.

    ``room[i]`` is how many words end at position i without leaving its run. It
    is built level by level: a phrase of m words that ends at i is its suffix of
    m-1 words and the word before that. ``count[m]`` has the end positions of
    each such phrase, ``where[m]`` one of them, ``link[m]`` the suffix, and
    ``shortest[m]`` the least length in its class; ``longest[m]`` tells whether
    no phrase of m+1 words is in the class.
    """

    def __init__(self, codes: np.ndarray, room: np.ndarray, depth: int):
        self.depth, top = depth, int(codes.max()) + 1 if len(codes) else 1
        self.count, self.where, self.link, self.shortest, self.longest = {}, {}, {}, {}, {}
        number, before = np.zeros(len(codes), dtype=np.int64), np.zeros(1, dtype=np.int64)
        for m in range(1, depth + 1):
            ends = np.flatnonzero(room >= m)
            keys = number[ends] * top + codes[ends - m + 1]
            _, where, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            where = ends[where]
            link = number[where]
            same = count == before[link] if m > 1 else np.zeros(len(count), dtype=bool)
            self.count[m], self.where[m], self.link[m] = count, where, link
            self.shortest[m] = np.where(same, self.shortest[m - 1][link], m) if m > 1 else np.ones(len(count), dtype=np.int64)
            self.longest[m] = np.ones(len(count), dtype=bool)
            if m > 1:
                self.longest[m - 1][link[same]] = False
            number = np.full(len(codes), -1, dtype=np.int64)
            number[ends], before = inverse, count

    def states(self, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(m, an end position, the least length from ``least`` on, end positions) of the states whose longest phrase has m words."""
        for m in range(least, self.depth + 1):
            at = np.flatnonzero(self.longest[m])
            yield m, self.where[m][at], np.maximum(self.shortest[m][at], least), self.count[m][at]


def shards(batches, limit: int = SHARD_BYTES) -> Iterator[tuple[str, bytes]]:
    """(language, pieces by lines) of bounded size, of batches of language and text; cut between pieces."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for k, text in enumerate(binary(batch.column(1))):
            if not text:
                continue
            lang = "und" if langs[k] is None else langs[k]
            own = text.translate(_NORMAL)
            held[lang].append(own)
            sizes[lang] += len(own) + 1
            if sizes[lang] >= limit:
                whole, at = b"\n".join([*held.pop(lang), b""]), 0
                while at < len(whole):
                    end = len(whole) if len(whole) - at <= 2 * limit else (whole.rfind(b"\n", at, at + limit) + 1 or whole.index(b"\n", at + limit) + 1)
                    yield lang, whole[at:end]
                    at = end
                sizes[lang] = 0
            elif sum(sizes.values()) >= 2 * limit:  # many languages
                for other in list(held):
                    yield other, b"\n".join(held.pop(other))
                sizes.clear()
    for lang in list(held):
        yield lang, b"\n".join(held.pop(lang))


def single_spaced(data: bytes) -> bytes:
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] of each as strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])])


def _keys(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """The filter's key of each phrase, from the hashes of its words one after another."""
    total = np.full(len(hashes[0]), np.frombuffer((lang.encode() + bytes(8))[:8], "<u8")[0] + np.uint64(len(hashes)), dtype=np.uint64)
    for own in hashes:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + own)
    return total


def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each key, its word in a filter of ``size`` words, and the five bits it has there."""
    bits = np.zeros(len(keys), dtype=np.uint64)
    for k in range(5):
        bits |= np.uint64(1) << (keys >> np.uint64(6 * k) & np.uint64(63))
    return (keys >> np.uint64(32)) % np.uint64(size), bits


def _has(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at, bits = _places(keys, len(words))
    return words[at] & bits == bits


def word_keys(words: DataFrame) -> DataFrame:
    """The filter's key of each word in ``phrase``."""

    def run(batches):
        for batch in batches:
            langs, own = np.array(batch.column(0).to_pylist(), dtype=object), binary(batch.column(1))
            data, starts, ends, _ = spans(own, _SPACES)
            hashes = word_hashes(data, starts, ends)
            for lang in set(langs):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(lang, [hashes[langs == lang]]).view(np.int64))], names=["key"])

    return words.select("lang", "phrase").mapInArrow(run, "key long")


def frequent_filter(keys: DataFrame) -> np.ndarray:
    """A blocked Bloom filter of ``key``, whose size is bounded whatever it holds."""
    size = min(FILTER_WORDS, keys.count() // PER_WORD + 1)

    def run(batches):
        for batch in batches:
            place, bits = _places(batch.column(0).to_numpy().view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(bits.view(np.int64))], names=["place", "bits"])

    table = keys.mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, dtype=np.uint64)
    words[table.column("place").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return words


class Shard:
    """A shard's words in runs, which end where a piece does or where ``known`` (filters of frequent words, or pairs) has no such part."""

    def __init__(self, lang: str, text: bytes, depth: int, known: dict[int, np.ndarray]):
        self.lang, self.depth = lang, depth
        self.data, self.starts, self.ends, _ = spans([single_spaced(text)], _SPACES)
        self.codes = exact_codes(self.data, self.starts, self.ends)
        piece = np.cumsum(self.data == 0x0A, dtype=np.int32)[self.starts]
        follows = np.zeros(len(self.codes), dtype=bool)  # the word before is in the same run
        follows[1:] = piece[1:] == piece[:-1]
        self.room = np.ones(len(self.codes), dtype=np.int8)
        if known:
            _, one, number = np.unique(self.codes, return_index=True, return_inverse=True)
            self.hashes = word_hashes(self.data, self.starts[one], self.ends[one])
            self.number = number
        if 1 in known:
            good = _has(known[1], _keys(lang, [self.hashes]))[number]
            self.room[~good] = 0
            follows[1:] &= good[1:] & good[:-1]
        if 2 in known:
            at = np.flatnonzero(follows)
            follows[at] = _has(known[2], _keys(lang, [self.hashes[number[at - 1]], self.hashes[number[at]]]))
        for m in range(2, depth + 1):
            self.room[np.flatnonzero(follows[1:] & (self.room[:-1] >= m - 1)) + 1] = m

    def pairs(self) -> pa.RecordBatch:
        """key and count of the pairs of words."""
        made = Automaton(self.codes, self.room, 2)
        at = made.where[2]
        keys = _keys(self.lang, [self.hashes[self.number[at - 1]], self.hashes[self.number[at]]])
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(made.count[2].astype(np.int64))], names=["key", "f"])

    def states(self, least: int) -> Iterator[pa.RecordBatch]:
        """The states of the automaton with phrases of ``least`` words or more; with words alone, too, their number as a row without a phrase."""
        if least == 1:
            yield _batch(self.lang, pa.nulls(1, pa.string()), [1], [1], [len(self.codes)])
        for m, where, shortest, count in Automaton(self.codes, self.room, self.depth).states(least):
            for a in range(0, len(where), 1 << 16):
                own = where[a : a + (1 << 16)]
                yield _batch(self.lang, _gathered(self.data, self.starts[own - m + 1], self.ends[own]).cast(pa.string()), shortest[a : a + len(own)], np.full(len(own), m), count[a : a + len(own)])


def _batch(lang: str, phrases: pa.Array, shortest, longest, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases, *[pa.array(x, pa.int64()) for x in (shortest, longest, count)]], names=["lang", "phrase", "shortest", "longest", "f"])


def _each_shard(docs: DataFrame, depth: int, known: dict[int, np.ndarray], shard_bytes: int, rows, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for lang, text in shards(batches, shard_bytes):
            if text.strip(b" \n"):
                yield from rows(Shard(lang, text, depth, shared.value))

    return docs.mapInArrow(run, schema)


def _counted(docs: DataFrame, depth: int, least: int, known: dict[int, np.ndarray], shard_bytes: int) -> DataFrame:
    """lang, phrase and its occurrences, of phrases of ``least`` to ``depth`` words (without those that hold a rare part)."""
    states = _each_shard(docs, depth, known, shard_bytes, lambda shard: shard.states(least), "lang string, phrase string, shortest long, longest long, f long")
    if depth > 1:
        states = states.withColumn("m", F.explode(F.sequence("shortest", "longest"))).withColumn("phrase", F.expr("substring_index(phrase, ' ', cast(-m as int))"))
    return states.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


class Phrases:
    """Frequent phrases of a table by language: ``frequent`` (lang, phrase, m, f) and ``totals`` (lang, n)."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST, shard_bytes: int = SHARD_BYTES):
        small_batches(docs.sparkSession)
        docs = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
        enough = F.col("f") >= least
        words = saved(_counted(docs, 1, 1, {}, shard_bytes).where(enough | F.col("phrase").isNull()), "words")
        self.totals = words.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
        words = words.where("phrase IS NOT NULL")
        self.frequent = words.withColumn("m", F.lit(1).cast("long"))
        if depth > 1:
            known = {1: frequent_filter(word_keys(words))}
            pairs = _each_shard(docs, 2, known, shard_bytes, lambda shard: [shard.pairs()], "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))
            known = {2: frequent_filter(saved(pairs.where(enough).select("key"), "pairs"))}
            longer = _counted(docs, depth, 2, known, shard_bytes).where(enough).withColumn("m", F.size(F.split("phrase", " ")).cast("long"))
            self.frequent = saved(self.frequent.unionByName(longer), "frequent")


def _looked_up(rows: DataFrame, key: str, counts: DataFrame, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``key``; saved, so that the next join deals out rows for itself and Spark may split a frequent key."""
    found = rows.join(counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(name)).hint("merge"), ["lang", key])
    return saved(found, f"counts-{name}")


def scored(phrases: Phrases, scale: int = SCALE, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r and score of the candidates that no longer one covers."""
    frequent = phrases.frequent
    candidates = frequent.where("m > 1")
    cuts = candidates.select("lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cast(k as int))")).withColumn("rest", F.expr("substring_index(phrase, ' ', cast(k - m as int))"))
    cuts = _looked_up(_looked_up(cuts, "head", frequent, "l"), "rest", frequent, "r")
    score = F.expr(f"cast(cast({scale} as decimal(20,0)) * cast(a as decimal(18,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    longer = candidates.where("m > 2").select("lang", "f", F.explode(F.array(_drop_first(), _drop_last())).alias("phrase"))
    around = longer.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * inside))
    return kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def _drop_first() -> Column:
    """Where a phrase's suffix link leads: to it without its first word."""
    return F.expr("substring_index(phrase, ' ', cast(1 - m as int))")


def _drop_last() -> Column:
    return F.expr("substring_index(phrase, ' ', cast(m - 1 as int))")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST, top: int = TOP, scale: int = SCALE, inside: int = INSIDE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases."""
    phrases = Phrases(docs, text, lang, depth, least, shard_bytes)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = scored(phrases, scale, inside).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # The best of each part, then of these: a language's phrases never meet in one task.
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(phrases.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, m, array_to_string(w[k : k + m - 1], ' ') AS phrase, count(*) AS f
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) AS s, unnest(range(1, len(w) - m + 2)) AS u(k) WHERE len(w) >= m
  GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (h.f + r.f))::BIGINT AS score
  FROM c, unnest(range(1, c.m)) AS u(k)
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT c.lang, array_to_string(c.w[i : i + s.m - 1], ' ') AS phrase, max(a) AS around
  FROM c, (SELECT unnest([2, 3]) AS m) AS s, unnest(range(1, c.m - s.m + 2)) AS u(i) WHERE s.m < c.m GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.phrase = b.phrase WHERE around IS NULL OR 100 * around < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN t USING (lang) QUALIFY rank <= 2000
"""
