"""Removal of repeated passages: difference-cover anchors, extended to whole windows.

A passage of ``WINDOW`` words that starts at any two places has, within its
first ``period`` words, an offset that puts both places on a cover position
modulo the period. So only the words' runs at cover positions (a third of all)
are hashed and exchanged as anchors; an anchor seen twice is extended to the
windows around it, and those windows are compared by 128-bit hashes. A window
whose words also start earlier is repeated, and its words are removed.

What is exchanged: sorted arrays of a part's distinct hashes by hash range, and
bitmaps back. Within a part equal hashes are one entry, so a passage that a
third of all documents share is one entry of each part, and no group of equal
passages is ever expanded into pairs.

Order is (doc_id, start of the window); null ids come first; rows with equal
ids count as one document for the order, and windows at equal (id, start) do
not remove each other. Defined results: a null or empty text has no words;
texts of fewer than ``WINDOW`` words keep all; an empty table gives no row; a very
long text is read whole, by one task at a time; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._parts import PART_BYTES, each_part, read_part, write_parts
from corpusloom.llm._shared import binary, blocks, saved
from corpusloom.llm._words import SPACES, spans, window_hashes, word_lanes

WINDOW = 20
#: Perfect difference sets: every difference modulo the period is one of two members (fixed values).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Words of the corpus for each range of hashes: what a task of the exchange holds grows with this, not with the corpus.
BUCKET_WORDS = 4 << 20
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_NULL = -(1 << 63)


def period_of(window: int) -> int:
    """The period whose anchors still have at least a third of the window's words."""
    return max((v for v in COVERS if 3 * (window - v + 1) >= window), default=1)


class Part:
    """The words of a part and the hashes of its anchors."""

    def __init__(self, ids: list[int | None], texts: list[bytes], window: int):
        self.keys, self.texts, self.window = ids, texts, window
        data, starts, ends, self.first = spans(texts, SPACES)
        self.words, self.second = word_lanes(data, starts, ends)
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.start = np.arange(n) - self.first[self.doc]
        self.left = self.first[self.doc + 1] - np.arange(n)
        self.ids = np.array([_NULL if i is None else i for i in ids], dtype=np.int64)
        self.period = period_of(window)
        size = window - self.period + 1
        cover = np.zeros(self.period, dtype=bool)
        cover[list(COVERS.get(self.period, (0,)))] = True
        long = (self.first[self.doc + 1] - self.first[self.doc]) >= window
        self.at = np.flatnonzero(cover[self.start % self.period] & (self.left >= size) & long)
        hashes = window_hashes(self.words, size, _SEEDS[0])
        self.anchors, self.inverse, counts = np.unique(hashes[self.at] if len(hashes) else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
        self.often = counts > 1

    def candidates(self, elsewhere: np.ndarray) -> np.ndarray:
        """Starts (as positions of words) of the windows with an anchor that this part or another repeats."""
        hit = np.zeros(len(self.words) + 1, dtype=np.int64)
        hit[self.at + 1] = (self.often | elsewhere)[self.inverse]
        total = np.cumsum(hit)
        fit = np.flatnonzero(self.left >= self.window)
        return fit[total[fit + self.period] > total[fit]]

    def windows(self, at: np.ndarray) -> dict[str, np.ndarray]:
        """The distinct windows that start at ``at``, sorted by hash, with their first (id, start), and the starts that come after it."""
        high, low = (window_hashes(lane, self.window, seed)[at] if len(at) else np.empty(0, np.uint64) for lane, seed in ((self.words, _SEEDS[1]), (self.second, _SEEDS[2])))
        ids, start = self.ids[self.doc[at]], self.start[at]
        order = np.lexsort((start, ids, low, high))
        at, high, low, ids, start = (x[order] for x in (at, high, low, ids, start))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        group = np.cumsum(new) - 1
        later = (ids > ids[new][group]) | (start > start[new][group])
        return {"high": high[new], "low": low[new], "ids": ids[new], "start": start[new].astype(np.int32), "later": at[later], "group": group[~later], "at": at[~later]}


def _bounds(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where the n equal ranges of the hash space begin and end in sorted hashes."""
    edges = np.array([k * (1 << 64) // n for k in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]]).astype(int)


def _batch(part: int, n: int, bounds: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    full = [k for k in range(n) if bounds[k] < bounds[k + 1]]
    blobs = [pa.array([x[bounds[k] : bounds[k + 1]].tobytes() for k in full], pa.binary()) for x in arrays]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([part] * len(full), pa.int64()), *blobs], names=["bucket", "part", *[f"x{i}" for i in range(len(arrays))]])


def _marks(found: DataFrame, name: str) -> DataFrame:
    """Bitmaps of all ranges of a part in one row."""
    return found.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias(name))


def _unpacked(marks: list | None, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(bounds[-1], dtype=bool)
    for one in marks or ():
        bucket, bits = one["bucket"], one["bits"]
        a, b = bounds[bucket], bounds[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a, bitorder="little")
    return out


def _reply(table: pa.Table, sizes: np.ndarray, flags: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    bits = [np.packbits(flags[e - s : e], bitorder="little").tobytes() for s, e in zip(sizes, ends, strict=True)]
    return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _join(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), dtype=kind), np.array([len(r) // width for r in raw])


def _repeated(table: pa.Table) -> pa.Table:
    """Of each part's anchors in a range of hashes, those that another part has, too."""
    hashes, sizes = _join(table.column("x0"), "<u8")
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return _reply(table, sizes, counts[inverse] > 1)


def _later(table: pa.Table) -> pa.Table:
    """Of each part's windows in a range of hashes, those that start earlier in another part."""
    high, sizes = _join(table.column("x0"), "<u8")
    low, ids, start = (_join(table.column(f"x{k}"), kind)[0] for k, kind in ((1, "<u8"), (2, "<i8"), (3, "<i4")))
    order = np.lexsort((start, ids, low, high))
    high, low, ids, start = (x[order] for x in (high, low, ids, start))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    group = np.cumsum(new) - 1
    flags = np.zeros(len(order), dtype=bool)
    flags[order] = (ids > ids[new][group]) | (start > start[new][group])
    return _reply(table, sizes, flags)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, bucket_words: int = BUCKET_WORDS, kept_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 (and the kept words, if asked for) of each row."""
    parts = write_parts(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "text", part_bytes)
    n = blocks(parts.agg(F.sum("n_bytes")).first()[0] or 0, 6 * bucket_words, docs.sparkSession.sparkContext.defaultParallelism)

    def load(path):
        table = read_part(path)
        return Part(table.column("id").to_pylist(), [t or b"" for t in binary(table.column("text"))], window)

    def anchors(part, path, _):
        own = load(path)
        yield _batch(part, n, _bounds(own.anchors, n), own.anchors)

    reply = "part long, bucket long, bits binary"
    exchanged = each_part(parts, anchors, "bucket long, part long, x0 binary")
    repeated = saved(_marks(exchanged.groupBy("bucket").applyInArrow(_repeated, reply), "anchors"), "anchors")

    def windows(part, path, got):
        own = load(path)
        found = own.windows(own.candidates(_unpacked(got["anchors"], _bounds(own.anchors, n))))
        yield _batch(part, n, _bounds(found["high"], n), found["high"], found["low"], found["ids"], found["start"])

    exchanged = each_part(parts, windows, "bucket long, part long, x0 binary, x1 binary, x2 binary, x3 binary", repeated)
    later = _marks(exchanged.groupBy("bucket").applyInArrow(_later, reply), "windows")
    marks = saved(repeated.join(later, "part", "left"), "windows")

    def removed(part, path, got):
        own = load(path)
        found = own.windows(own.candidates(_unpacked(got["anchors"], _bounds(own.anchors, n))))
        elsewhere = _unpacked(got["windows"], _bounds(found["high"], n))
        edges = np.zeros(len(own.words) + window + 1, dtype=np.int32)
        for starts in (found["later"], found["at"][elsewhere[found["group"]]]):
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + window, -1)
        keep = np.cumsum(edges)[: len(own.words)] == 0
        rows = []
        for k, one in enumerate(own.texts):
            a, b = own.first[k], own.first[k + 1]
            words, mask = one.split(), keep[a:b]
            left = b" ".join(words if mask.all() else compress(words, mask.tolist()))
            rows.append((own.keys[k], int(b - a), int(b - a - mask.sum()), hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "replace")] if kept_text else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for a in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 4096], strict=True), kinds, strict=False)], names=[key, "n_words", "n_removed", "kept_sha256", *(["kept"] if kept_text else [])])

    return each_part(parts, removed, f"{key} long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * kept_text, marks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(k)),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS n FROM s),
g AS (SELECT DISTINCT doc_id, p FROM f, unnest(range(k, k + 20)) AS t(p) WHERE n > 1),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """The definition, for tests."""
    import re

    texts = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    order = lambda i: (i is not None, i or 0)
    least: dict[tuple, tuple] = {}
    for i, words in texts:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            least[w] = min(least.get(w, (order(i), k)), (order(i), k))
    out = []
    for i, words in texts:
        gone = {p for k in range(len(words) - window + 1) if (order(i), k) > least[tuple(words[k : k + window])] for p in range(k, k + window)}
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(words) if p not in gone).encode()).hexdigest()))
    return out
