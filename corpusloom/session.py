"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: Rows and bytes of one Arrow batch handed to Python: what a worker holds depends on neither a task's rows nor their length.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with the settings above; ``more`` has dots written as two underscores."""
    builder = SparkSession.builder.appName("corpusloom")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one that ``spark.checkpoint.dir`` names; a temporary one only where none is set and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read again: rows stay in the partitions and order they have once for all."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes; smaller bounds that are set already stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, str(most))
        if not (now.isdigit() and 0 < int(now) < most):
            spark.conf.set(name, str(most))
