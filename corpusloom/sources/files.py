"""Files as tables: site configurations, Markdown, chunk lines, manifests; and the tables written."""

from __future__ import annotations

from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE

SITE = "source string, url string, site_map boolean, license string"
CHUNK = "page_content string, metadata map<string,string>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """The site configurations of a JSON array."""
    return spark.read.schema(SITE).option("multiLine", True).json(path)


def _files(spark: SparkSession, folder: str, kind: str, glob: str | None, recursive: bool):
    reader = spark.read.format(kind).option("recursiveFileLookup", recursive)
    return reader.option("pathGlobFilter", glob) if glob else reader


def read_markdown(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, name, size, mtime and content of each Markdown file."""
    rows = _files(spark, folder, "text", "*.md", recursive).option("wholetext", True).load(folder)
    meta = lambda c: F.col(f"_metadata.{c}")
    return rows.select(meta("file_path").alias("path"), meta("file_name").alias("name"), meta("file_size").alias("size"), meta("file_modification_time").alias("mtime"), F.col("value").alias("content"))


def list_files(spark: SparkSession, folder: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, mtime and size of all files; contents are not read."""
    return _files(spark, folder, "binaryFile", glob, recursive).load(folder).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def hash_files(spark: SparkSession, folder: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, mtime, size and SHA-256 of all files."""
    rows = _files(spark, folder, "binaryFile", glob, recursive).load(folder)
    return rows.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(rf"(?U)\A{SPACE}*\z")), F.lit(True))


def read_chunks(spark: SparkSession, folder: str, only: DataFrame | None = None, key: str = "file") -> DataFrame:
    """page_content, metadata and file of the chunks in JSON lines below ``folder``, blank ones left out.

    ``only``: a table of the files (paths below the folder) to read; an absent
    folder has no chunks. Lists and objects in the metadata are left out.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], f"{CHUNK}, {key} string")
    rows = spark.read.schema("page_content string, metadata string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json{,l}").json(folder)
    plain = F.map_filter(F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>"), lambda k, v: ~F.startswith(v, F.lit("[")) & ~F.startswith(v, F.lit("{")))
    below = F.regexp_replace(F.col("_metadata.file_path"), rf"^.*?{_tail(folder)}/", "")
    out = rows.select("page_content", plain.alias("metadata"), below.alias(key)).where(~is_blank(F.col("page_content")))
    return out if only is None else out.join(only.select(key).distinct(), key, "left_semi")


def _tail(folder: str) -> str:
    import re

    return re.escape(folder.rstrip("/").rsplit("/", 1)[-1])


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest table, empty where there is none yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_chunks(chunks: DataFrame, folder: str, partition: str = "cache_key") -> None:
    """Chunks as JSON lines, one folder for each source; only the sources written are replaced. A large source is several files, in order."""
    chunks.repartitionByRange(partition, "chunk_index").sortWithinPartitions(partition, "chunk_index").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).json(folder)


def _marked(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders ``level=NAME`` below ``path`` that were written to their end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/level=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(f.getPath().getParent().getName().split("=", 1)[1] for f in found)


def read_pages(spark: SparkSession, path: str) -> DataFrame | None:
    """The pages of all levels below ``path`` that were written to their end, with ``level``; None if there are none."""
    names = _marked(spark, path)
    return spark.read.option("basePath", path).parquet(*[f"{path.rstrip('/')}/level={n}" for n in names]) if names else None


def write_new_pages(pages: DataFrame, path: str, level: str, key: str = "path", order: str = "url") -> DataFrame:
    """Write those pages whose key no other level below ``path`` has, as the level of that name; a level written again takes its own place.

    Of pages with one key the first by ``order`` is written. All pages are
    returned, so that links of known ones are followed, too.
    """
    spark = pages.sparkSession
    others = [n for n in _marked(spark, path) if n != level]
    fresh = pages.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")
    if others:
        fresh = fresh.join(spark.read.parquet(*[f"{path.rstrip('/')}/level={n}" for n in others]).select(key), key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/level={level}")
    return pages


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, batch) of the versions below ``path`` that were written to their end, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version=*/batch=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    names = [f.getPath().getParent() for f in found]
    return sorted((int(n.getParent().getName().split("=")[1]), n.getName().split("=", 1)[1]) for n in names)


_CLAIMS = Lock()


def _created(fs, path) -> bool:
    """Whether the file was made; not if it was there, or came meanwhile."""
    try:
        return fs.createNewFile(path)
    except Py4JJavaError:
        if fs.exists(path):
            return False
        raise


def claimed(spark: SparkSession, path: str, name: str) -> int:
    """The number that ``name`` has below ``path``; if it has none, the next one, which no other name can have.

    A number is a file that is created only if it is not there, which shared file
    systems do at one stroke; so of several drivers that want one at the same
    time one gets it, and the others go on to the next. Within a driver a lock
    does the same, as local files need it.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    folder = path_of(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    with _CLAIMS:
        fs.mkdirs(folder)
        own, number = f"{name}.", 0
        for status in fs.listStatus(folder):
            file = status.getPath().getName()
            if file.isdigit():
                number = max(number, int(file) + 1)
            elif file.startswith(own):
                return int(file[len(own) :])
        # The name is found by its own file, written after the number is taken; a number without one is never used.
        while not _created(fs, path_of(folder, str(number))):
            number += 1
        _created(fs, path_of(folder, f"{own}{number}"))
        return number


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders ``version=N`` below ``path`` that were written to their end, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def write_vectors(vectors: DataFrame, path: str, version: int, batch: str) -> str:
    """What a batch adds to a collection, in a folder of its own, so no path is overwritten while it is read."""
    target = f"{path.rstrip('/')}/version={version}/batch={batch}"
    vectors.write.mode("overwrite").parquet(target)
    return target


def read_pdfs(spark: SparkSession, folder: str, convert) -> DataFrame:
    """path and markdown of the PDF files in a folder; ``convert`` (bytes to text) comes from a library of the caller's."""
    import pyarrow as pa

    rows = _files(spark, folder, "binaryFile", "*.pdf", False).load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for data in batch.column(1).to_pylist():
                try:
                    texts.append(convert(data))
                    errors.append(None)
                except Exception as e:  # one broken file must not end the job
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "markdown", "error"])

    return rows.mapInArrow(run, "path string, markdown string, error string")
