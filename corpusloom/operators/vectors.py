"""Embedding and nearest vectors.

The default embedder hashes words to signed buckets (Weinberger et al. 2009);
any function from texts to vectors can take its place. Search is exact: queries
are sent to the vectors in blocks of bounded size and each task keeps the k best
of each query, so what is shuffled is k rows for each query and task.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import stored

DIMENSIONS, K = 64, 4
#: Bytes of query vectors sent out at once.
QUERY_BYTES = 32 << 20
#: Scores worked out at a time.
BLOCK_SCORES = 1 << 21
#: Stands for no key.
_NONE = np.iinfo(np.int64).max
METRICS = ("cosine", "ip", "l2")


def hashed(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors (zero for a text without words)."""
    out = np.zeros((len(texts), dimensions))
    for row, text in zip(out, texts, strict=True):
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            row[h % dimensions] += 1 if h >> 20 & 1 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def embedder(make: Callable[[], Callable[[list[str | None]], np.ndarray]] = lambda: hashed):
    """UDF from texts to vectors; ``make`` loads the model once for each task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(model(texts.tolist())))

    return run


def careful_embedder(make: Callable[[], Callable[[list[str | None]], np.ndarray]] = lambda: hashed, attempts: int = 3, wait: float = 4.0, most: float = 10.0):
    """UDF to struct<embedding, error>: a batch that fails is tried again, then text by text, and what still fails is a row with its error.

    Waits double from ``wait`` to ``most`` seconds; a job never ends by one text.
    """
    kind = T.StructType([T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()

        def tried(texts: list[str | None], times: int):
            for k in range(times):
                try:
                    return list(model(texts)), None
                except Exception as e:  # whatever the model raises
                    error = f"{type(e).__name__}: {e}"
                    if k + 1 < times:
                        time.sleep(min(most, wait * 2**k))
            return None, error

        for texts in batches:
            vectors, error = tried(texts.tolist(), attempts)
            if error is None:
                rows = [(v, None) for v in vectors]
            else:
                rows = [(v[0] if v else None, e) for v, e in (tried([t], 1) for t in texts)]
            yield pd.DataFrame(rows, columns=["embedding", "error"])

    return run


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Nearness of two vectors in double precision; the negative square distance for l2."""
    d = lambda x: x.cast("double")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: d(p) * d(q)), F.lit(0.0), lambda s, v: s + v)
    if metric == "ip":
        return dot(a, b)
    if metric == "l2":
        return -F.aggregate(F.zip_with(a, b, lambda p, q: (d(p) - d(q)) * (d(p) - d(q))), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    raise ValueError(f"metric {metric!r} is none of {METRICS}")


def topk(vectors: DataFrame, query: list[float], k: int = K, key: str = "vec_id", embedding: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k vectors nearest to one query, by score and then key."""
    near = score(F.col(embedding), F.array(*[F.lit(float(x)) for x in query]), metric)
    return vectors.withColumn("score", F.round(near, 9)).orderBy(F.desc_nulls_last("score"), key).limit(k)


def _scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    dot = queries @ rows.T
    if metric == "ip":
        return dot
    if metric == "l2":
        return 2 * dot - (queries**2).sum(axis=1)[:, None] - (rows**2).sum(axis=1)
    size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)
    return np.divide(dot, size, out=np.full_like(dot, -np.inf), where=size > 0)


class Nearest:
    """The k rows nearest to each query seen so far, by rounded score and then key; scores are worked out in blocks of bounded size."""

    def __init__(self, ids: np.ndarray, asked: np.ndarray, k: int, metric: str):
        self.ids, self.asked, self.k, self.metric = ids, asked, k, metric
        self.scores, self.keys = np.full((len(ids), k), -np.inf), np.full((len(ids), k), _NONE, dtype=np.int64)

    def add(self, keys: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        """Rows that count for the queries of numbers ``which`` (all of them)."""
        which = np.arange(len(self.ids)) if which is None else which
        step = max(1, BLOCK_SCORES // max(1, len(rows)))
        for a in range(0, len(which) if len(rows) else 0, step):
            own = which[a : a + step]
            scores = np.concatenate([self.scores[own], np.round(_scores(self.asked[own], rows, self.metric), 9) + 0.0], axis=1)
            names = np.concatenate([self.keys[own], np.broadcast_to(keys, (len(own), len(keys)))], axis=1)
            order = np.lexsort((names, -scores), axis=1)[:, : self.k]
            self.scores[own], self.keys[own] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)

    def batch(self) -> pa.RecordBatch:
        q, held = np.repeat(self.ids, self.k), self.keys.ravel() != _NONE
        return pa.RecordBatch.from_arrays([pa.array(q[held]), pa.array(self.keys.ravel()[held]), pa.array(self.scores.ravel()[held])], names=["q", "k", "score"])


def query_blocks(queries: DataFrame, query_key: str, embedding: str, query_bytes: int, found: Callable[[np.ndarray, np.ndarray], DataFrame]) -> DataFrame:
    """``found(ids, vectors)`` of blocks of the queries; with several blocks, a block's result is stored before the next is sent out."""
    asked = queries.select(F.col(query_key).cast("long").alias("q"), F.col(embedding).alias("e")).where("e IS NOT NULL")
    total = asked.agg(F.sum(F.size("e") * 8)).first()[0] or 0
    n = int(total // query_bytes + 1)
    out = None
    for block in range(n):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == block).collect()
        part = found(np.array([r.q for r in rows], dtype=np.int64), np.array([r.e for r in rows], dtype=float).reshape(len(rows), -1 if rows else 1))
        part = stored(part, "nearest") if n > 1 else part
        out = part if out is None else out.union(part)
    return out


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", query_key: str = "query_id", embedding: str = "embedding", metric: str = "cosine", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_key, key, score, rank) of the k vectors nearest to each query, by rounded score and then key.

    The queries are a stated set, gone through in blocks of ``query_bytes``. Rows and queries without a vector are left out.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    rows = vectors.where(F.col(embedding).isNotNull()).select(F.col(key).cast("long"), embedding)

    def found(ids: np.ndarray, asked: np.ndarray) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((ids, asked))

        def run(batches):
            best = Nearest(*shared.value, k, metric)
            for batch in batches:
                if batch.num_rows and len(best.ids):
                    best.add(batch.column(0).to_numpy(zero_copy_only=False), np.stack([np.asarray(v, dtype=float) for v in batch.column(1).to_pylist()]))
            yield best.batch()

        return rows.mapInArrow(run, "q long, k long, score double")

    out = query_blocks(queries, query_key, embedding, query_bytes, found)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "k"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("k").alias(key), "score", "rank")
