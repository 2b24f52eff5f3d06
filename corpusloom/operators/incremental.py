"""Change tracking: manifests, statuses, deletes, upserts, batches, retries.

Every decision is an equi-join on a key, so it shuffles two narrow tables by it
and Spark splits skewed keys. There are two manifests, one of what was chunked
and one of what was embedded: chunking a file does not make it embedded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import stored

#: Attempts before a chunk stays in the dead-letter table, and chunks of a batch.
ATTEMPTS, BATCH = 3, 100
#: Characters of the runs by which parts of paths are looked for.
GRAM = 6


def cache_status(current: DataFrame, manifest: DataFrame, key: str, force: bool = False) -> DataFrame:
    """``current`` (key, mtime, size, content_hash, config if it has one) with ``status``.

    unchanged: same time and size; touched: same hash; changed; new. Other
    chunking settings make a file changed. ``force`` makes all but new ones so.
    """
    columns = ["mtime", "size", "content_hash", *(["config"] if "config" in current.columns and "config" in manifest.columns else [])]
    known = manifest.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_known"))
    same = F.lit(True) if "config" not in columns else F.col("config").eqNullSafe(F.col("_config"))
    stats = (F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size"))
    status = (
        F.when(F.col("_known").isNull(), "new").when(F.lit(force) | ~same, "changed")
        .when(F.coalesce(stats, F.lit(False)), "unchanged").when(F.coalesce(F.col("content_hash") == F.col("_content_hash"), F.lit(False)), "touched").otherwise("changed")
    )
    return current.join(known, key, "left").withColumn("status", status).select(*current.columns, "status")


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """cache_file and status (new or modified) of what must be embedded anew.

    ``files``: cache_file, jsonl_mtime and the source's mtime, size and
    content_hash as they are now (null if it can't be read). A manifest row
    without statistics falls back to the time of the chunk file.
    """
    known = manifest.select("cache_file", *[F.col(c).alias(f"_{c}") for c in ("mtime", "size", "content_hash", "jsonl_mtime")], F.lit(True).alias("_known"))
    whole = F.col("_mtime").isNotNull() & F.col("_size").isNotNull() & F.col("_content_hash").isNotNull()
    moved = ~(F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size")))
    modified = F.when(whole, moved & ~F.col("content_hash").eqNullSafe(F.col("_content_hash"))).otherwise(~F.coalesce(F.col("jsonl_mtime") == F.col("_jsonl_mtime"), F.lit(False)))
    status = F.when(F.col("_known").isNull(), "new").when(modified, "modified")
    return files.join(known, "cache_file", "left").select("cache_file", status.alias("status")).where("status IS NOT NULL")


def deleted_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows whose file is gone."""
    return manifest.join(files.select("cache_file"), "cache_file", "left_anti")


def _grams(c: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(c, k, n)))).otherwise(F.expr("cast(array() as array<string>)"))


def paths_holding(paths: DataFrame, parts: DataFrame, column: str = "file_path", gram: int = GRAM) -> DataFrame:
    """The distinct paths of ``paths`` that hold a string of ``parts`` (a table with the same column) anywhere, by equi-joins.

    A part is looked for by that of its runs of ``gram`` characters which the
    fewest paths have, among the runs of all paths, and what meets there is
    compared. A part shorter than that is itself such a run, of its own length.
    Each path holds the empty part; null parts are held by none.
    """
    every = paths.select(F.col(column).alias("path")).where("path IS NOT NULL").distinct()
    asked = parts.select(F.col(column).alias("part")).where("part IS NOT NULL").distinct()
    lengths = sorted(r[0] for r in asked.select(F.least(F.length("part"), F.lit(gram)).alias("n")).distinct().collect())  # ``gram`` + 1 rows at most
    if 0 in lengths:
        return every
    found = every.limit(0)
    for n in lengths:
        own = asked.where(F.length("part") == n) if n < gram else asked.where(F.length("part") >= n)
        postings = every.select("path", F.explode(_grams(F.col("path"), n)).alias("gram"))
        keys = own.select("part", F.explode(_grams(F.col("part"), n)).alias("gram"))
        if n == gram:
            often = postings.join(keys.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
            rare = keys.join(often, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
            keys = stored(rare.where("x.n > 0").select("part", "x.gram"), "parts")
        found = found.union(postings.join(keys, "gram").where(F.contains("path", F.col("part"))).select("path"))
    return found.distinct()


def delete_by_source(vectors: DataFrame, sources: DataFrame, column: str = "file_path", substring: bool = False) -> DataFrame:
    """``vectors`` without those of ``sources`` (a table with the same column).

    ``substring`` deletes paths that hold a source anywhere. The paths are found
    by their runs of characters, so that, too, is an equi-join of two tables of
    any size.
    """
    gone = paths_holding(vectors, sources, column).withColumnRenamed("path", "_gone") if substring else sources.select(F.col(column).alias("_gone")).where("_gone IS NOT NULL").distinct()
    return vectors.join(gone, F.col(column) == F.col("_gone"), "left_anti")


def upsert(vectors: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``new`` (one row for each key, the last of equals by all columns) over ``vectors``; doing it twice changes nothing."""
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in new.columns if c != key])
    latest = new.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return vectors.join(latest.select(key), key, "left_anti").unionByName(latest.select(*vectors.columns))


def assign_batches(rows: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """``rows`` with ``batch_no`` from 1 on: ``size`` consecutive rows a batch by ``order``.

    Ranges of the order are numbered apart and shifted by the counts before
    them, so no task sees all rows. The ranges are stored, as drawing them
    again might give others.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(rows.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # a row for each partition
    before, total = {}, 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        before[r["_part"]], total = total, total + r["_n"]
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + shift
    return ranged.withColumn("batch_no", (F.floor(place / size) + 1).cast("long")).drop("_part")


def retryable(dead: DataFrame, chunks: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Chunks whose last failure was not the last attempt they have, with ``attempt`` (the next one)."""
    last = dead.groupBy("chunk_id").agg(F.max("attempt").alias("_last")).where(F.col("_last") < attempts)
    return chunks.join(last, "chunk_id").withColumn("attempt", (F.col("_last") + 1).cast("int")).drop("_last")


def to_embed(chunks: DataFrame, embedded: DataFrame, mode: str = "incremental") -> DataFrame:
    """Chunks that the manifest of embedded ones lacks; all of them in mode ``rebuild``."""
    if mode not in ("incremental", "rebuild"):
        raise ValueError(f"mode {mode!r} is neither incremental nor rebuild")
    return chunks if mode == "rebuild" else chunks.join(embedded.select("chunk_id"), "chunk_id", "left_anti")
