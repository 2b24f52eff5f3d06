import shutil

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunk_store as cs
from corpusloom.operators.chunk import Strategy
from corpusloom.sources.files import committed, read_markdown

FILES = "path string, mtime double, size long, content string"
SHORT = cs.Settings(Strategy.HEADERS, 40, 5, keywords=False)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def rows(spark, root):
    return {r.path: r.asDict() for r in cs.manifest(spark, root).collect()}


def texts(spark, root):
    found = cs.chunks(spark, root).orderBy("path", "chunk_index").collect()
    return {p: [r.page_content for r in found if r.path == p] for p in {r.path for r in found}}


def test_statuses_and_versions(spark, root):
    first = [("a/x.md", 1.0, 5, "# A\nalpha"), ("b/x.md", 1.0, 4, "beta"), ("c.md", 1.0, 0, ""), ("d.md", 1.0, 9, None)]
    assert cs.chunk_incremental(spark.createDataFrame(first, FILES), root, SHORT) == {"new": 4}
    assert texts(spark, root) == {"a/x.md": ["# A\nalpha"], "b/x.md": ["beta"]}  # one name in two folders: two files
    assert {p: r["num_chunks"] for p, r in rows(spark, root).items()} == {"a/x.md": 1, "b/x.md": 1, "c.md": 0, "d.md": 0}

    # Nothing changed: nothing is written.
    assert cs.chunk_incremental(spark.createDataFrame(first, FILES), root, SHORT) == {"unchanged": 4}
    assert committed(spark, f"{root}/manifest") == [0]

    second = [("a/x.md", 2.0, 5, "# A\nalpha"), ("b/x.md", 2.0, 5, "gamma"), ("c.md", 1.0, 0, ""), ("e.md", 1.0, 1, "new")]
    assert cs.chunk_incremental(spark.createDataFrame(second, FILES), root, SHORT) == {"unchanged": 1, "touched": 1, "changed": 1, "new": 1}
    now = rows(spark, root)
    assert (now["a/x.md"]["mtime"], now["a/x.md"]["chunks_version"], now["a/x.md"]["status"]) == (2.0, 0, "touched")
    assert (now["b/x.md"]["chunks_version"], now["b/x.md"]["num_chunks"]) == (1, 1)
    assert texts(spark, root) == {"a/x.md": ["# A\nalpha"], "b/x.md": ["gamma"], "e.md": ["new"]} and "d.md" in now

    # The touched file is now known by its new time.
    assert cs.chunk_incremental(spark.createDataFrame(second, FILES), root, SHORT) == {"unchanged": 4}
    assert cs.chunk_incremental(spark.createDataFrame(second, FILES), root, SHORT, drop_deleted=True) == {"unchanged": 4, "deleted": 1}
    assert "d.md" not in rows(spark, root)
    assert cs.chunk_incremental(spark.createDataFrame(second, FILES), root, SHORT, drop_deleted=True) == {"unchanged": 4, "deleted": 0}


def test_settings_and_force(spark, root):
    files = spark.createDataFrame([("a", 1.0, 1, "one two three " * 9)], FILES)
    cs.chunk_incremental(files, root, SHORT)
    before = len(texts(spark, root)["a"])
    assert cs.chunk_incremental(files, root, cs.Settings(Strategy.HEADERS, 80, 5, keywords=False)) == {"unchanged": 0, "changed": 1}
    assert len(texts(spark, root)["a"]) < before
    assert cs.chunk_incremental(files, root, cs.Settings(Strategy.HEADERS, 80, 5, keywords=False), force=True) == {"unchanged": 0, "changed": 1}
    assert rows(spark, root)["a"]["chunks_version"] == 2
    cs.compact(spark, root)
    assert rows(spark, root)["a"]["chunks_version"] == 3 and len(texts(spark, root)["a"]) < before
    assert cs.chunk_incremental(files, root, cs.Settings(Strategy.HEADERS, 80, 5, keywords=False)) == {"unchanged": 1}


def test_a_run_that_died_before_its_manifest(spark, root):
    files = spark.createDataFrame([("a", 1.0, 1, "one"), ("b", 1.0, 1, "two")], FILES)
    cs.chunk_incremental(files, root, SHORT)
    more = files.union(spark.createDataFrame([("c", 1.0, 1, "three")], FILES))
    cs.chunk_incremental(more, root, SHORT)
    shutil.rmtree(f"{root}/manifest/version=1")  # its chunks are there, its manifest is not
    assert set(texts(spark, root)) == {"a", "b"}
    assert cs.chunk_incremental(more, root, SHORT) == {"unchanged": 2, "new": 1}
    assert texts(spark, root) == {"a": ["one"], "b": ["two"], "c": ["three"]} and committed(spark, f"{root}/manifest") == [0, 1]


def test_odd_rows(spark, root):
    empty = spark.createDataFrame([], FILES)
    assert cs.chunk_incremental(empty, root, SHORT) == {}
    assert committed(spark, f"{root}/manifest") == []
    odd = spark.createDataFrame([(None, 1.0, 1, "x", "u"), ("a", 1.0, 1, "old", "u"), ("a", 2.0, 1, "new", "u"), ("a", 2.0, 1, "new", "u"), ("b", None, None, "no time", "u"), ("long", 1.0, 1, "w " * 200000, "u")], FILES + ", status string")
    assert cs.chunk_incremental(odd, root, SHORT) == {"new": 3}
    assert texts(spark, root)["a"] == ["new"] and len(texts(spark, root)["long"]) > 5000
    # A file without a time is compared by its content.
    assert cs.chunk_incremental(odd, root, SHORT) == {"unchanged": 2, "touched": 1}
    only = spark.createDataFrame([("b",)], "path string")
    assert [r.page_content for r in cs.chunks(spark, root, only).collect()] == ["no time"]


def test_files_of_a_folder(spark, root, tmp_path):
    folder = tmp_path / "md"
    (folder / "sub").mkdir(parents=True)
    (folder / "one.md").write_text("---\ntitle: T\n---\n# One\ntext\n")
    (folder / "sub" / "two.md").write_text("two")
    files = lambda: read_markdown(spark, str(folder)).withColumn("mtime", F.col("mtime").cast("double"))
    assert cs.chunk_incremental(files(), root, SHORT) == {"new": 2}
    (folder / "sub" / "two.md").write_text("two and a half")
    assert cs.chunk_incremental(files(), root, SHORT) == {"unchanged": 1, "changed": 1}
    assert sorted(r.page_content for r in cs.chunks(spark, root).collect()) == ["# One\ntext", "two and a half"]
