"""Directories as streams: files are cleaned, chunked, embedded and upserted as they appear.

A collection is a log of versions, each what one batch added: rows of vectors,
and marks (rows without a chunk id) that say which file's earlier rows go, or,
without a path, that all go. A batch writes what it changes, never the whole
collection; :func:`compact` writes it anew when the log has grown long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from corpusloom.operators.chunk import Strategy, chunk_documents
from corpusloom.operators.clean import process
from corpusloom.operators.incremental import retryable, to_embed, upsert
from corpusloom.operators.vectors import careful_embedder
from corpusloom.sources.files import claimed, read_or_empty, versions, write_vectors

META = "keywords array<string>, metadata array<struct<key:string,value:string>>"
DEAD = f"chunk_id string, path string, page_content string, section_path string, {META}, attempt int, error string, ts timestamp, batch_id bigint, batch string"
VECTOR = f"chunk_id string, path string, page_content string, section_path string, {META}, embedding array<float>"


def embed_batch(files: DataFrame, batch_id: int, root: str, strategy: Strategy | str = Strategy.SIZE, mode: str = "incremental", embed=None) -> dict[str, int]:
    """Clean, chunk and embed a batch of files (name, size, content, source, path) into the collection below ``root``.

    A version is named by its batch, so a batch that is run again writes the
    same version again. Chunks that could not be embedded go to the dead-letter
    table instead. What is returned tells how many chunks were tried and failed;
    it is counted while they are written.
    """
    chunks = chunk_documents(process(files), "path", "updated", strategy)
    return _store(chunks, f"files-{batch_id}", root, mode, embed, attempt=F.lit(1), whole_files=True)


def _store(chunks: DataFrame, batch: str, root: str, mode: str, embed, attempt, whole_files: bool) -> dict[str, int]:
    spark = chunks.sparkSession
    # A batch's version is its own, so a retry and the stream's batches may run at the same time; one that runs again has the version it had.
    version = claimed(spark, f"{root}/versions", batch)
    old = _rows(spark, root, version)
    todo = to_embed(chunks, old, mode).withColumn("_x", (embed or careful_embedder())("page_content")).withColumn("_attempt", attempt)
    todo = todo.select("chunk_id", "path", "page_content", "section_path", "keywords", "metadata", F.col("_x.embedding").alias("embedding"), F.col("_x.error").alias("error"), F.col("_attempt").cast("int").alias("attempt"))
    counts = Observation("chunks")
    todo.observe(counts, F.count(F.lit(1)).alias("tried"), F.count_if(F.col("error").isNotNull()).alias("failed")).write.mode("overwrite").parquet(f"{root}/tried/batch={version}")
    tried = spark.read.parquet(f"{root}/tried/batch={version}")  # embedded once, used three times
    fields = spark.createDataFrame([], VECTOR).columns
    new, dead = tried.where("error IS NULL").select(*fields), tried.where("error IS NOT NULL")
    rows = new
    if whole_files:  # chunks that their file no longer has go, the others have the file's frontmatter of now
        now = chunks.select("chunk_id", "section_path", "metadata").dropDuplicates(["chunk_id"])
        held = old.drop("section_path", "metadata").join(now, "chunk_id").select(*fields)
        rows = upsert(held if mode == "incremental" else held.limit(0), new)
        gone = chunks.select("path").distinct() if mode == "incremental" else spark.createDataFrame([(None,)], "path string")
        rows = rows.unionByName(gone, allowMissingColumns=True)
    stamp = [F.lit(version).cast("long").alias("batch_id"), F.lit(batch).alias("batch"), F.current_timestamp().alias("at")]
    writer = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "batch")
    writer(new.select("chunk_id", F.col("path").alias("file_path"), F.sha2("page_content", 256).alias("content_hash"), *stamp).withColumnRenamed("at", "embedded_at")).parquet(f"{root}/embedded")
    writer(dead.select("chunk_id", "path", "page_content", "section_path", "keywords", "metadata", "attempt", "error", *stamp).withColumnRenamed("at", "ts")).parquet(f"{root}/dead_letter")
    write_vectors(rows, f"{root}/vectors", version, batch)  # written last: readers see the version from here on
    return {k: int(v or 0) for k, v in counts.get.items()}


def retry_dead_letters(spark: SparkSession, root: str, retry_id: int, embed=None) -> dict[str, int]:
    """Try again what failed, has attempts left, is not in the collection and whose file was not read anew since; retries are numbered apart from the stream's batches."""
    dead = read_or_empty(spark, f"{root}/dead_letter", DEAD)
    marks = _marks(_log(spark, root)).withColumnRenamed("path", "_path")
    dead = dead.join(marks, F.col("path") == F.col("_path"), "left").where("_since IS NULL OR batch_id >= _since").drop("_path", "_since")
    last = dead.dropDuplicates(["chunk_id"]).select("chunk_id", "path", "page_content", "section_path", "keywords", "metadata")
    return _store(retryable(dead, last), f"retry-{retry_id}", root, "incremental", embed, attempt=F.col("attempt"), whole_files=False)


def stream_directory(spark: SparkSession, folder: str, root: str, strategy: Strategy | str = Strategy.SIZE, told: Callable[[dict[str, int]], None] | None = None) -> StreamingQuery:
    """Take up the Markdown files that are in ``folder`` and not yet in the collection; ends when all are. ``told`` gets each batch's counts."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    meta = lambda c: F.col(f"_metadata.{c}")
    files = rows.select(meta("file_path").alias("path"), meta("file_name").alias("name"), meta("file_size").alias("size"), F.element_at(F.split(meta("file_path"), "/"), -2).alias("source"), F.col("value").alias("content"))

    def batch(df: DataFrame, k: int) -> None:
        counts = embed_batch(df, k, root, strategy)
        if told:
            told(counts)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def _log(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """All rows and marks of the versions (below ``before``), with ``version``."""
    kept = [v for v in versions(spark, f"{root}/vectors") if before is None or v[0] < before]
    if not kept:
        return spark.createDataFrame([], f"{VECTOR}, version long")
    paths = [f"{root}/vectors/version={v}/batch={b}" for v, b in kept]
    return spark.read.schema(f"{VECTOR}, version long, batch string").option("basePath", f"{root}/vectors").parquet(*paths).drop("batch")


def _marks(log: DataFrame) -> DataFrame:
    """path and the last version that read it whole (a null path: the last one that began anew)."""
    return log.where("chunk_id IS NULL").groupBy("path").agg(F.max("version").alias("_since"))


def _rows(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The collection as it was before a version, by default as it is now."""
    log = _log(spark, root, before)
    marks = _marks(log)
    anew = marks.where("path IS NULL").agg(F.max("_since")).first()[0]
    rows = log.where("chunk_id IS NOT NULL") if anew is None else log.where("chunk_id IS NOT NULL").where(F.col("version") >= anew)
    return rows.join(marks.where("path IS NOT NULL"), "path", "left").where("_since IS NULL OR version >= _since").drop("_since", "version")


def collection(spark: SparkSession, root: str) -> DataFrame:
    """The collection as it is now."""
    return _rows(spark, root)


def compact(spark: SparkSession, root: str) -> None:
    """Write the collection as one version that the older ones are not needed for."""
    known = versions(spark, f"{root}/vectors")
    if known:
        anew = spark.createDataFrame([(None,)], "path string")
        batch = f"compact-{known[-1][0]}"
        version = claimed(spark, f"{root}/versions", batch)
        write_vectors(_rows(spark, root, version).unionByName(anew, allowMissingColumns=True), f"{root}/vectors", version, batch)


class _Memory(StatefulProcessor):
    """Keeps a conversation's number of turns and its last texts, which go when nothing was said for a time."""

    def __init__(self, conv: str, turn: str | None, text: str, most: int, keep_ms: int | None):
        self.conv, self.turn, self.text, self.most, self.keep_ms = conv, turn, text, most, keep_ms

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long", self.keep_ms)
        self.texts = handle.getListState("texts", "text string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names that Spark calls
        import pandas as pd

        new, n = [], self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            n += len(frame)
            order = frame[self.turn] if self.turn else pd.Series(range(len(frame)))
            new += list(zip(order.tolist(), frame[self.text].tolist(), strict=True))
            new = sorted(new, key=lambda x: x[0])[-self.most :] if self.turn else new[-self.most :]
        fresh = [(t,) for _, t in new]
        held = [r[0] for r in self.texts.get()] if self.texts.exists() else []
        # Texts are appended; the list is written anew only when half of it is past its use.
        if len(held) + len(fresh) > 2 * self.most:
            self.texts.put([(t,) for t in [*held, *[t for (t,) in fresh]][-self.most :]])
        elif fresh:
            self.texts.appendList(fresh)
        self.count.update((n,))
        recent = [*held, *[t for (t,) in fresh]][-self.most :]
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [n], "recent": [recent]})

    def close(self) -> None:
        pass


def conversation_memory(turns: DataFrame, conv: str = "conv_id", text: str = "text", most: int = 20, turn: str | None = None, keep_ms: int | None = None) -> DataFrame:
    """A stream of (conv_id, n_turns, recent): each conversation's number of turns and its last ``most`` texts.

    ``turn`` orders the turns of one batch. What a conversation has said is state
    of the stream, a list to which texts are appended, and with ``keep_ms`` it is
    forgotten when so many milliseconds have gone by; such a stream looks at the
    clock again and again, so it wants a trigger of processing time, not one that
    ends. The session's state store must be RocksDB's.
    """
    columns = [conv, text, *([turn] if turn else [])]
    memory = _Memory(conv, turn, text, most, keep_ms)
    return turns.select(*columns).groupBy(conv).transformWithStateInPandas(memory, "conv_id long, n_turns long, recent array<string>", "Update", "ProcessingTime" if keep_ms else "None")


def replayed(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stream of rows to the end of what is there now; every batch is appended below ``folder`` under its own number."""
    rows.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/batch={k}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
