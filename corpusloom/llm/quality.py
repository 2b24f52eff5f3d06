"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a vector of transformed statistics (length, word
shapes, symbols, repetition). Per class, moments of the labelled rows are summed
in the executors; the driver turns them into means and shrunk covariances and
their Cholesky factors, and a score is the logistic of the difference of the
classes' Mahalanobis log-densities and log-priors.

Defined results: a null text is an empty one and has a score like any other; a
null document id is never held out and never labelled; repeated rows are scored
each, repeated labels count each; null labels are not learned from; without
labels of both classes the score is the (smoothed) share of label 1; an empty
table gives no row; very long texts are worked on one at a time, whole; scores
at the threshold count as 1, and ties need no order. Extra columns, of whatever
names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._shared import binary, saved, small_batches, steps
from corpusloom.llm._words import SPACES, spans, word_hashes

THRESHOLD = 0.3
#: Every FOLDS-th crc32 of a document id is held out.
FOLDS = 5
#: Weight of the pooled diagonal in a class's covariance, and the least variance.
SHRINKAGE, RIDGE = 0.1, 0.05

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(0x61, 0x7B)]] = 1
_CLASS[[*range(0x41, 0x5B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[0x20, *range(0x09, 0x0E)]] = 4
_CLASS[[*b".,;:?'\"()-"]] = 5
_CLASS[[b for b in range(0x21, 0x7F) if _CLASS[b] == 0]] = 6
_CLASS[0x80:] = 7
NAMES = ["log_words", "word_bytes", "upper", "digits", "spaces", "points", "symbols", "beyond_ascii", "lines", "caps_words", "marked_words", "repeats", "distinct", "top_word"]


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of transformed statistics for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    for a, b in steps(texts):
        out[a:b] = _statistics(texts[a:b])
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _statistics(texts: list[bytes]) -> np.ndarray:
    data, starts, ends, first = spans(texts, SPACES)
    at = np.cumsum([1, *[len(t) + 1 for t in texts]])
    kind = _CLASS[data]
    size = np.maximum(np.array([len(t) for t in texts], dtype=float), 1)
    shares = {k: _sums(kind == k, at) for k in range(1, 8)}
    shares[4] = shares[4] - 1  # the separator after each text
    lines = _sums(data == 0x0A, at)
    words = np.diff(first)
    n = np.maximum(words, 1).astype(float)
    hashes = word_hashes(data, starts, ends)
    text_of = np.repeat(np.arange(len(texts)), words)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    upper_start = kind[starts] == 2
    caps = upper_start & (kind[np.minimum(starts + 1, len(kind) - 1)] == 2) & (ends - starts > 1)
    marked = kind[ends - 1] == 6
    order = np.lexsort((hashes, text_of))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    heads = np.flatnonzero(new)
    counts = np.diff([*heads, len(order)]) if len(heads) else np.zeros(0, dtype=int)
    owner = text_of[order][heads]
    top = np.zeros(len(texts))
    np.maximum.at(top, owner, counts)
    distinct = np.bincount(owner, minlength=len(texts))
    letters = np.maximum(shares[1] + shares[2], 1)
    share = lambda x, of: np.log(x / of + 0.5 / (of + 20))
    columns = [
        np.log1p(words), np.log((size - shares[4]) / n + 0.5), share(shares[2], letters), share(shares[3], size), share(shares[4], size), share(shares[5], n), share(shares[6], n),
        np.sqrt(shares[7] / size), share(lines, n), share(_sums(caps, first), n), share(_sums(marked, first), n), share(_sums(same, first), n),
        np.log(np.maximum(distinct, 1)) - 0.85 * np.log(n), share(top, n),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Gaussian:
    """A class's share, mean and the inverse of its covariance's Cholesky factor."""

    log_prior: float
    mean: np.ndarray
    inverse: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = self.inverse @ (x - self.mean).T
        return self.log_prior - 0.5 * (self.log_det + (z * z).sum(axis=0))


@dataclass
class Model:
    """The discriminant; ``prior`` alone where a class has no labelled rows."""

    classes: tuple[Gaussian, Gaussian] | None
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        low, high = (c.log_density(x) for c in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def model_of(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model:
    """From (rows, sum, sum of outer products) of the classes 0 and 1."""
    n = [moments[k][0] if k in moments else 0.0 for k in (0, 1)]
    prior = (n[1] + 1) / (sum(n) + 2)
    if min(n) < 2:
        return Model(None, prior)
    means = [moments[k][1] / n[k] for k in (0, 1)]
    covariances = [moments[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = np.diag(np.diag(n[0] * covariances[0] + n[1] * covariances[1]) / sum(n))
    classes = []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * covariances[k] + shrinkage * pooled + ridge * np.eye(len(NAMES)))
        classes.append(Gaussian(float(np.log(n[k] / sum(n))), means[k], np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return Model(tuple(classes), prior)


def held_out(key: str = "doc_id", folds: int = FOLDS):
    """Whether a row's label is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` of each row; no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = statistics([t or b"" for t in binary(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from all labelled rows that aren't held out; only sums reach the driver."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = stats.where(~held_out()).join(known, "doc_id").select("label", "stats")
    width = 1 + len(NAMES) + len(NAMES) ** 2

    def run(batches):
        sums = np.zeros((2, width))
        for batch in batches:
            label_of = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            for k in (0, 1):
                own = x[label_of == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], width), pa.int32()), pa.array(np.tile(np.arange(width), 2), pa.int32()), pa.array(sums.ravel())], names=["label", "place", "value"])

    total = rows.mapInArrow(run, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, width))
    for r in total.collect():  # 2 * width rows, however many documents there are
        sums[r.label, r.place] = r.value
    d = len(NAMES)
    return model_of({k: (sums[k, 0], sums[k, 1 : d + 1], sums[k, d + 1 :].reshape(d, d)) for k in (0, 1) if sums[k, 0]})


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # a few matrices

    def run(batches):
        for batch in batches:
            s = shared.value.scores(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those the classifier rejects; texts are never shuffled."""
    model = fit(saved(with_statistics(docs), "statistics"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            s = shared.value.scores(statistics([t or b"" for t in binary(batch.column(place))]))
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(with_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "statistics")
    return score(stats, fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
