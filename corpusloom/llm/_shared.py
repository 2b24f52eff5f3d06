"""Shared storage, Arrow batch and table helpers of the training-data operators.

Executors may be lost at any time and share no local folders with each other,
so whatever one job hands to the next lies in the folder that
``spark.checkpoint.dir`` names, written by Spark's own commit protocol or under
a name that only a committed row mentions.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python, so that a batch of long texts fits a worker.
ARROW_ROWS = 512
#: Bytes of text that one numpy step works on.
STEP_BYTES = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only where none is configured and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below :func:`shared_root`."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows; texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a path or URI (file, hdfs, s3, gs) and the path in it."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path if scheme else uri
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, blocks: Iterator[bytes]) -> int:
    """Write a file under a name of its own; returns its length."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    size = 0
    with fs.open_output_stream(path, compression=None) as out:  # no second compression by the name's suffix
        for block in blocks:
            out.write(block)
            size += len(block)
    return size


def attempt_name(index: int) -> str:
    """A file name that no other task attempt uses."""
    return f"{index:06d}-{uuid.uuid4().hex}"


def binary(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, or the bytes of a binary one."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes, each of one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def blocks(total: int, each: int, least: int = 1) -> int:
    """How many blocks of ``each`` hold ``total``."""
    return max(least, math.ceil(total / each))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
