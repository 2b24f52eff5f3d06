"""Incremental chunking into a store of versions, with the manifest of what was chunked.

Below a store's root, ``chunks/version=N`` has the chunks that run N made and
``manifest/version=N`` a row for each file whose state that run changed. The
manifest is written last, so its ``_SUCCESS`` commits both: a run that dies
before leaves nothing that readers see, and the next one takes its number. A
file's row of the highest version holds; it names the version its chunks are in.
A run that finds nothing to do writes no version. One writer at a time.

Statuses come from narrow rows (path, time, size). The contents of files whose
time and size are as the manifest says are dropped before they are hashed or
dealt out, and on a store without versions no join takes place at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.chunk import OVERLAP, SIZE, Strategy, chunk_documents
from corpusloom.session import stored
from corpusloom.sources.files import committed

MANIFEST = "path string, mtime double, size bigint, content_hash string, config string, num_chunks bigint, chunks_version bigint, status string, processed_at timestamp"
NEW, CHANGED, TOUCHED, UNCHANGED, DELETED = "new", "changed", "touched", "unchanged", "deleted"


@dataclass(frozen=True)
class Settings:
    """How files are chunked; files chunked with other settings are chunked anew."""

    strategy: Strategy | str = Strategy.SIZE
    size: int = SIZE
    overlap: int = OVERLAP
    keywords: bool = True

    def fingerprint(self) -> str:
        return f"keywords={self.keywords};overlap={self.overlap};size={self.size};strategy={Strategy(self.strategy).value}"


def history(spark: SparkSession, root: str) -> DataFrame:
    """All manifest rows of committed runs, with ``version``."""
    known = committed(spark, f"{root}/manifest")
    if not known:
        return spark.createDataFrame([], f"{MANIFEST}, version long")
    return spark.read.schema(f"{MANIFEST}, version long").option("basePath", f"{root}/manifest").parquet(*[f"{root}/manifest/version={v}" for v in known])


def _latest(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c not in ("path", "version")]
    return rows.groupBy("path").agg(F.max_by(F.struct(*names), "version").alias("x")).select("path", *[f"x.{c}" for c in names])


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest as it is now: a row for each file that was not found to be gone."""
    return _latest(history(spark, root)).where(F.col("status") != DELETED)


def chunks(spark: SparkSession, root: str, only: DataFrame | None = None, about: tuple[str, ...] = ()) -> DataFrame:
    """The chunks of all files as they are now, with ``version`` and the columns ``about`` of the manifest; ``only``: a table whose ``path`` names the files asked for."""
    known = manifest(spark, root).select("path", "chunks_version", *about)
    if only is not None:
        known = known.join(only.select("path").distinct(), "path", "left_semi")
    have = committed(spark, f"{root}/manifest")
    if not have:
        raise FileNotFoundError(f"no run was committed below {root}")
    rows = spark.read.option("basePath", f"{root}/chunks").option("mergeSchema", "true").parquet(*[f"{root}/chunks/version={v}" for v in have])
    rows = rows.withColumn("version", F.col("version").cast("long"))
    return rows.join(known, "path").where(F.col("version") == F.col("chunks_version")).drop("chunks_version")


def _decided(files: DataFrame, known: DataFrame, config: str, force: bool) -> DataFrame:
    """path, mtime, size and what the manifest has of each file; ``same`` tells whether time, size and settings are all as they were."""
    old = known.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), "content_hash", "config", "num_chunks", "chunks_version", F.lit(True).alias("known"))
    rows = files.select("path", "mtime", "size").join(old, "path", "left")
    fits = F.coalesce(F.col("config") == config, F.lit(False)) & ~F.lit(force)
    same = fits & F.coalesce((F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size")), F.lit(False))
    return rows.select("path", F.coalesce("known", F.lit(False)).alias("known"), fits.alias("fits"), same.alias("same"), F.col("content_hash").alias("old_hash"), F.col("num_chunks").alias("old_chunks"), F.col("chunks_version").alias("old_version"))


def _hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def chunk_incremental(files: DataFrame, root: str, settings: Settings | None = None, force: bool = False, drop_deleted: bool = False, at: Column | None = None) -> dict[str, int]:
    """Chunk what is new or changed of ``files`` (path, mtime, size, content) into the store; the number of files by status.

    unchanged: time and size are as they were; touched: only these differ, so
    the manifest's row is refreshed and the chunks stay; changed: the content or
    the settings differ, or ``force`` is given. With ``drop_deleted``, files that
    are no longer there go. Of rows with equal paths the one with the largest
    time, size and content counts; rows without a path are left out; a null
    content is an empty file, which has a row in the manifest and no chunks.
    """
    spark, settings = files.sparkSession, settings or Settings()
    config, at = settings.fingerprint(), F.current_timestamp() if at is None else at
    have = committed(spark, f"{root}/manifest")
    version = have[-1] + 1 if have else 0
    files = files.select("path", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"), "content").where("path IS NOT NULL")
    known = manifest(spark, root)
    counts: dict[str, int] = {}
    if have:
        narrow = files.select("path", "mtime", "size").groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("x")).select("path", "x.mtime", "x.size")
        decided = stored(_decided(narrow, known, config, force), "decided")
        counts[UNCHANGED] = decided.where("same").count()
        # Contents meet the files in question alone; Spark sends these out whole where they are few.
        rows = files.join(decided.where("NOT same").drop("same"), "path")
    else:
        none = {"known": "boolean", "fits": "boolean", "old_hash": "string", "old_chunks": "long", "old_version": "long"}
        rows = files.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    rows = rows.withColumn("content_hash", _hash(F.col("content")))
    touched = F.coalesce(F.col("fits") & (F.col("content_hash") == F.col("old_hash")), F.lit(False))
    rows = rows.withColumn("status", F.when(~F.coalesce("known", F.lit(False)), NEW).when(touched, TOUCHED).otherwise(CHANGED))
    rows = rows.withColumn("content", F.when(F.col("status") != TOUCHED, F.coalesce("content", F.lit(""))))
    if _repeated(files):
        latest = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("size"), F.desc("content_hash"))
        rows = rows.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")
    if have:
        rows = stored(rows, "files")  # the contents of those files alone, which are needed twice
    facts = stored(rows.drop("content"), "facts")
    for r in facts.groupBy("status").count().collect():  # a row for each status
        counts[r["status"]] = r["count"]
    if drop_deleted:
        gone = stored(known.join(files.select("path"), "path", "left_anti"), "gone")
        counts[DELETED] = gone.count()
    if not any(n for s, n in counts.items() if s != UNCHANGED):
        return counts
    todo = rows.where(F.col("status") != TOUCHED)
    target = f"{root}/chunks/version={version}"
    made = chunk_documents(todo, "path", "content", settings.strategy, settings.size, settings.overlap, settings.keywords)
    made.write.mode("overwrite").parquet(target)
    per_file = spark.read.parquet(target).groupBy("path").agg(F.count("*").alias("made"))
    out = facts.join(per_file, "path", "left")
    fresh = F.col("status") != TOUCHED
    out = out.select(
        "path", "mtime", "size", "content_hash", F.lit(config).alias("config"), F.when(fresh, F.coalesce("made", F.lit(0))).otherwise(F.col("old_chunks")).cast("long").alias("num_chunks"),
        F.when(fresh, F.lit(version)).otherwise(F.col("old_version")).cast("long").alias("chunks_version"), "status", at.alias("processed_at"),
    )
    if drop_deleted:
        out = out.unionByName(gone.select(*[c for c in out.columns if c not in ("status", "processed_at")], F.lit(DELETED).alias("status"), at.alias("processed_at")))
    out.write.mode("overwrite").parquet(f"{root}/manifest/version={version}")  # this commits the run
    return counts


def _repeated(files: DataFrame) -> bool:
    """Whether some path comes more than once (from narrow rows)."""
    return not files.groupBy("path").count().where("count > 1").isEmpty()


def compact(spark: SparkSession, root: str) -> None:
    """Write all chunks and rows of now as one version, after which older ones can go."""
    have = committed(spark, f"{root}/manifest")
    if have:
        version = have[-1] + 1
        chunks(spark, root).drop("version").write.mode("overwrite").parquet(f"{root}/chunks/version={version}")
        rows = _latest(history(spark, root))
        rows.withColumn("chunks_version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
