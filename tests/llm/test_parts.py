import pyarrow as pa

from corpusloom.llm import _parts


def test_numbers_rows_and_tasks(spark):
    rows = [(k, None if k % 7 == 0 else f"text {k} " * (k % 5)) for k in range(400)] + [(400, "long " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = _parts.write_parts(docs, "text", 100).collect()
    numbers = [p.part for p in parts]
    assert len(parts) > 40 and len(set(numbers)) == len(numbers) and sum(p.n_docs for p in parts) == len(rows)
    assert {n // _parts.PARTITION_PARTS for n in numbers} <= set(range(5))
    assert max(numbers) * _parts.PART_ROWS < 1 << 62
    table = spark.createDataFrame(parts)
    wanted = table.select("part", (table.part * 2).alias("double"))

    def run(part, path, got):
        own = _parts.read_part(path)
        yield pa.RecordBatch.from_arrays([pa.array([part] * own.num_rows, pa.int64()), own.column("doc_id").combine_chunks(), pa.array([got["double"]] * own.num_rows, pa.int64())], names=["part", "doc_id", "double"])

    out = _parts.each_part(table, run, "part long, doc_id long, double long", wanted)
    assert out.rdd.getNumPartitions() == _parts.TASKS * 4  # the session has four shuffle partitions
    got = out.collect()
    assert sorted(r.doc_id for r in got) == list(range(401)) and all(r["double"] == 2 * r.part for r in got)
    few = _parts.each_part(table, run, "part long, doc_id long, double long", wanted.where(wanted.part == numbers[0]), only=True).collect()
    assert {r.part for r in few} == {numbers[0]}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    parts = _parts.write_parts(docs, "text")
    assert parts.collect() == [] and _parts.each_part(parts, lambda *a: iter(()), "part long").collect() == []
