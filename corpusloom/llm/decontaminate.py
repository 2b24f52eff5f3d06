"""Benchmark decontamination by Wu-Manber search over words.

Words are runs of ASCII letters (lower-cased), digits and characters from
U+0080 on. A window is ``WINDOW`` consecutive words of a benchmark item, or all
words of a shorter item. The search looks at blocks of two words: the shift
table tells how far the position may move on without passing an occurrence, a
block that ends some window leads to the bucket of those windows, and comparing
the words themselves confirms one. Windows of different length have tables of
their own, so short items do not shorten the shifts of the others.

Defined results: a null or empty text has no words and no hits; an empty
benchmark hits nothing, and an empty table of documents gives no row; a null
item, or one with a null id, has no window; item ids that repeat, and items that
tie in a window, count once each;
repeated documents are judged each; a very long text is searched whole. Extra
columns, of whatever names, are not read by the query and pass through
:func:`clean`.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._shared import binary, saved, small_batches
from corpusloom.llm._words import NORMAL

WINDOW = 10
#: The tables are built from so many bytes of benchmark text at once; a larger benchmark is searched for in several passes.
TABLE_BYTES = 8 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class WuManber:
    """Tables for patterns (lists of words) of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], frozenset]):
        self.size = len(next(iter(patterns)))
        self.block = min(2, self.size)
        self.default = self.size - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        self.items = patterns
        for words in patterns:
            for end in range(self.block, self.size + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), self.size - end)
            self.buckets[words[-self.block :]].append(words)

    def find(self, words: list[bytes]) -> list[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of each occurrence, in order."""
        found, size, block, shift, default = [], self.size, self.block, self.shift.get, self.default
        at, n = size, len(words)
        while at <= n:
            step = shift((words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],), default)
            if step:
                at += step
                continue
            for pattern in self.buckets[tuple(words[at - block : at])]:
                if words[at - size] == pattern[0] and tuple(words[at - size : at]) == pattern:
                    found.append((at - size, pattern))
            at += 1
        return found


class Benchmark:
    """The windows of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        by_size: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = tuple(words_of(text))
            for k in range(max(1, len(words) - window + 1) if words else 0):
                own = words[k : k + window]
                by_size[len(own)][own].add(item)
        self.tables = [WuManber({k: frozenset(v) for k, v in patterns.items()}) for _, patterns in sorted(by_size.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint ranges of hit words in order, and the items found."""
        ranges, items = [], set()
        for table in self.tables:
            for start, pattern in table.find(words):
                ranges.append((start, start + table.size))
                items |= table.items[pattern]
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[tuple[list[tuple[str, bytes | None]], bool]]:
    """The items in parts of about ``limit`` bytes of text, and whether more follow; the driver holds one part at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // limit + 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield [(r.item, r.text.encode()) for r in (rows.where(part == k) if n > 1 else rows).collect()], k + 1 < n


_tables: dict[str, Benchmark] = {}


def _built(name: str, part, window: int) -> Benchmark:
    """The tables of a part, built once in a worker process; those of an earlier part go."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = Benchmark(part(), window)
    return _tables[name]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with n_words, ``hits`` (ranges of words, from and to) and ``items`` (ids found); no shuffle.

    A benchmark beyond ``table_bytes`` takes a pass for each part of it, and
    what each pass found is saved before the next. Columns of the caller's with
    these three names give way.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    out = docs.select(*[F.col(f"`{c}`") for c in keep]).select("*", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<array<long>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    schema, names = out.schema, out.columns
    for part, more in _parts(benchmark, item, item_text, table_bytes):
        shared, named = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches, shared=shared, named=named):
            tables = _built(named, lambda: shared.value, window)
            for batch in batches:
                counts, hits, items = [], batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                for k, one in enumerate(binary(batch.column(text))):
                    words = words_of(one)
                    ranges, found = tables.hits(words)
                    counts.append(len(words))
                    hits[k] = [list(r) for r in merged([*map(tuple, hits[k]), *ranges])]
                    items[k] = sorted({*items[k], *found})
                new = {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, pa.list_(pa.list_(pa.int64()))), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

        out = out.mapInArrow(run, schema)
        if more:
            out = saved(out, "scanned")
            shared.destroy()
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a window of a benchmark item; same columns."""
    names = docs.columns
    found = scan(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), benchmark, text=f"c{names.index('text')}", window=window)
    return found.where(F.size("items") == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )




SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, k, n.n, array_to_string(w[k : k + n.n - 1], ' ') AS s
  FROM d, n, unnest(range(1, len(w) - n.n + 2)) AS t(k) WHERE len(w) >= n.n),
hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN bw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM hit), unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
