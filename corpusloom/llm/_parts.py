"""Documents as numbered part files in shared storage.

An operator that must come back to the texts several times writes them once, in
parts of bounded size, and then exchanges only fingerprints and bitmaps: texts
are never shuffled, and a row is named for good by its part and its place in it.
The table of parts is saved by Spark's commit protocol, so files of lost task
attempts are never read.

Defined results: an empty table has no part; null texts and ids are kept as they
are; a text longer than a part is a part of its own, held whole by one task; equal
rows are rows each, told apart by their places; all columns are kept, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm._shared import attempt_name, binary, filesystem, saved, shared_dir, small_batches

#: Text bytes of one part.
PART_BYTES = 8 << 20
#: A row's number is its part's number times PART_ROWS, plus its place.
PART_BITS = 24
PART_ROWS = 1 << PART_BITS
#: A part's number is that of the partition it was written from, times this, plus its place among those.
PARTITION_PARTS = 1 << 19
#: Partitions of a step over the parts, for each of the session's shuffle partitions, at most.
TASKS = 4


def write_parts(docs: DataFrame, text: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write all columns of ``docs``; one row for each part: part, path, n_docs, n_bytes, n_words (a bound).

    A part is numbered where it is written. Of a partition's attempts one is
    committed, so numbers are unique; they have gaps and tell no order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder, schema, place = shared_dir(spark, "parts"), to_arrow_schema(docs.schema), docs.columns.index(text)

    def run(batches):
        index, held, size, words, number = TaskContext.get().partitionId(), [], 0, 0, count()
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))

        def flush():
            path = f"{folder}/{attempt_name(index)}.arrow"
            fs, at = filesystem(path)
            fs.create_dir(folder if "://" not in folder else filesystem(folder)[1], recursive=True)
            table = pa.Table.from_batches(held, schema)
            with fs.open_output_stream(at) as out, pa.ipc.new_file(out, schema, options=options) as file:
                file.write_table(table)
            part = index * PARTITION_PARTS + next(number)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), *[pa.array([n], pa.int64()) for n in (table.num_rows, size, words)]], names=["part", "path", "n_docs", "n_bytes", "n_words"])

        for batch in batches:
            own = batch.cast(schema) if batch.schema != schema else batch
            lengths = [len(t or b"") for t in binary(own.column(place))]
            start = 0
            for k, n in enumerate(lengths):
                size, words = size + n, words + n // 2 + 1
                if size >= part_bytes or k - start >= PART_ROWS - 1:
                    held.append(own.slice(start, k + 1 - start))
                    yield flush()
                    held, size, words, start = [], 0, 0, k + 1
            if start < len(lengths):
                held.append(own.slice(start))
        if held:
            yield flush()

    return saved(docs.mapInArrow(run, "part long, path string, n_docs long, n_bytes long, n_words long"), "part-table")


def read_part(path: str) -> pa.Table:
    fs, at = filesystem(path)
    with fs.open_input_file(at) as file, pa.ipc.open_file(file) as reader:
        return reader.read_all()


def each_part(parts: DataFrame, run, schema, results: DataFrame | None = None, only: bool = False) -> DataFrame:
    """``run(part, path, results)`` for each part, in at most ``TASKS`` tasks for each shuffle partition; it yields record batches.

    ``results``: a table with a column part and one row for each part at most,
    whose other columns ``run`` gets as a dict (empty if there is no row). With
    ``only``, parts without such a row are left out.
    """
    names = [] if results is None else [c for c in results.columns if c != "part"]
    rows = parts.select("part", "path")
    if results is not None:
        rows = rows.join(results, "part", "inner" if only else "left").select("part", "path", *names)
    most = TASKS * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(max(1, min(parts.count(), most)), "part")

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from run(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), {n: batch.column(2 + i)[k].as_py() for i, n in enumerate(names)})

    return rows.mapInArrow(work, schema)
