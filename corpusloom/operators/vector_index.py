"""Approximate nearest vectors: inverted lists, stored a partition each and probed without a scan of the others.

Centroids come from k-means over a bounded sample (``SAMPLE_ROWS``); every row is
put in the list of its nearest centroid. How many lists a query probes is measured,
too: the least number with which queries of the sample, compared with all of the
sample, reach the asked recall of their ``k`` nearest others. In the whole table
neighbours are nearer than in a sample of it, so its recall is no lower by this.
Vectors without any structure need many probes (the more so in many dimensions),
clustered ones few; ``Index.shares`` tells which part of the sample was scanned.

Rows without a vector are in no list, as exact search does not find them either;
a vector of length 0 is in the first list and never found by cosine. Equal
vectors share a list, however many: a list is several files then.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.vectors import K, QUERY_BYTES, Nearest, query_blocks

#: Rows that centroids and probes are learned from; lists at most; rows of the sample for each list at least; rounds of k-means.
SAMPLE_ROWS, MAX_LISTS, ROWS_PER_LIST, ROUNDS = 20_000, 4096, 40, 10
#: Queries of the sample with which recall is measured, and the recall asked for.
TRIALS, RECALL = 256, 0.97
METRICS = ("cosine", "l2")


@dataclass
class Index:
    """An index below ``path``; with p probes, recall on the sample was ``recalls[p - 1]`` and the share of it scanned ``shares[p - 1]``."""

    path: str
    metric: str
    centroids: np.ndarray
    probes: int
    recalls: list[float]
    shares: list[float]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("key long, embedding array<float>, list int").parquet(f"{self.path}/lists")


def _prepared(rows: np.ndarray, metric: str) -> np.ndarray:
    rows = np.asarray(rows, dtype=float)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12) if metric == "cosine" else rows


def _distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Square distances, less what is the same for all centroids."""
    return (centroids**2).sum(axis=1) - 2 * rows @ centroids.T


def kmeans(rows: np.ndarray, n: int, metric: str = "cosine", rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids of ``rows`` (prepared); of unit length for cosine. One that loses all its rows takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), n, replace=False)].copy()
    for _ in range(rounds):
        far = _distances(rows, centroids)
        own = far.argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        count = np.bincount(own, minlength=n)
        spare = np.argsort(-far[np.arange(len(rows)), own])
        for k, lost in enumerate(np.flatnonzero(count == 0)):
            sums[lost], count[lost] = rows[spare[k]], 1
        centroids = _prepared(sums, metric) if metric == "cosine" else sums / count[:, None]
    return centroids


def measured(rows: np.ndarray, centroids: np.ndarray, k: int, trials: int = TRIALS) -> tuple[list[float], list[float]]:
    """Recall of the k nearest other rows, and the share of rows scanned, by the number of lists probed."""
    own = _distances(rows, centroids).argmin(axis=1)
    asked = np.linspace(0, len(rows) - 1, min(trials, len(rows))).astype(int)
    far = -2 * rows[asked] @ rows.T + (rows**2).sum(axis=1)
    far[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
    order = np.argsort(_distances(rows[asked], centroids), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each list, when a query probes it
    when = np.take_along_axis(place, own[near], axis=1)
    sizes = np.bincount(own, minlength=len(centroids))[order].cumsum(axis=1)
    n = range(len(centroids))
    return [float((when <= p).mean()) if when.size else 1.0 for p in n], [float(sizes[:, p].mean() / max(len(rows), 1)) for p in n]


def build(vectors: DataFrame, path: str, key: str = "vec_id", embedding: str = "embedding", metric: str = "cosine", lists: int | None = None, k: int = K, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Write the index of ``vectors`` below ``path``; ``lists`` is about half the square root of the rows if not given."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{embedding}`").cast("array<float>").alias("embedding")).where("embedding IS NOT NULL")
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("embedding").toArrow().column(0).to_pylist()
    known = _prepared(np.array(sample, dtype=float).reshape(len(sample), -1 if sample else 1), metric)
    n = lists or int(np.sqrt(rows.count()) / 2)
    n = max(1, min(n, MAX_LISTS, len(known) // ROWS_PER_LIST))
    centroids = kmeans(known, n, metric) if len(known) else np.zeros((1, 0))
    recalls, shares = measured(known, centroids, k) if len(known) else ([1.0], [1.0])
    probes = next((p for p, r in enumerate(recalls, 1) if r >= recall), n)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                own = _distances(_prepared(np.array(part.column(1).to_pylist(), dtype=float), metric), shared.value).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.int32())], names=["key", "embedding", "list"])

    # Spark puts small lists together and takes large ones apart.
    placed = rows.mapInArrow(run, "key long, embedding array<float>, list int").hint("rebalance", "list")
    placed.write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    about = {"metric": metric, "probes": probes, "recalls": recalls, "shares": shares}
    table = vectors.sparkSession.createDataFrame([(json.dumps(about), [c.tolist() for c in centroids])], "about string, centroids array<array<double>>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")  # written last: it makes the index whole
    return Index(path, metric, centroids, probes, recalls, shares)


def load(spark: SparkSession, path: str) -> Index:
    row = spark.read.parquet(f"{path}/centroids").first()
    about = json.loads(row["about"])
    return Index(path, about["metric"], np.array(row["centroids"]), about["probes"], about["recalls"], about["shares"])


def search(index: Index, queries: DataFrame, k: int = K, query_key: str = "query_id", embedding: str = "embedding", probes: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_key, key, score, rank) of the k nearest rows in the lists each query probes, by rounded score and then key.

    Queries are a stated set, gone through in blocks; a block reads the lists that one of its queries probes, and no others.
    """
    spark, probes = queries.sparkSession, min(probes or index.probes, len(index.centroids))
    metric = index.metric

    def found(ids: np.ndarray, asked: np.ndarray) -> DataFrame:
        some = len(ids) and index.centroids.shape[1]  # an index of no rows has one empty list
        order = np.argsort(_distances(_prepared(asked, metric), index.centroids), axis=1, kind="stable")[:, :probes] if some else np.zeros((len(ids), 1), int)
        wanted = np.unique(order).tolist()
        shared = spark.sparkContext.broadcast((ids, asked, order))

        def run(batches):
            ids, asked, order = shared.value
            best = Nearest(ids, asked, k, metric)
            whose = {int(c): np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order)}
            for batch in batches:
                lists = batch.column(2).to_numpy()
                for c in np.unique(lists):
                    own = batch.filter(pa.array(lists == c))
                    best.add(own.column(0).to_numpy(), np.array(own.column(1).to_pylist(), dtype=float), whose[int(c)])
            yield best.batch()

        return index.rows(spark).where(F.col("list").isin(wanted)).mapInArrow(run, "q long, k long, score double")

    out = query_blocks(queries, query_key, embedding, query_bytes, found)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "k"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("k").alias("key"), "score", "rank")


def recall(found: DataFrame, exact: DataFrame, query_key: str = "query_id", key: str = "vec_id") -> float:
    """Which share of ``exact`` (query_key, key) is in ``found`` (query_key, key); 1 if there is nothing to find."""
    total, hit = exact.count(), exact.join(found.select(query_key, F.col("key").alias(key)), [query_key, key], "left_semi").count()
    return hit / total if total else 1.0
