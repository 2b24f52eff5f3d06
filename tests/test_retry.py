"""Retries and the stream's batches share a collection without taking each other's place."""

import numpy as np

from corpusloom.operators import vectors as vc
from corpusloom.sources.files import versions
from corpusloom.streaming import ingest


def _files(spark, *names):
    rows = [(f"{n}.md", 200, f"# Title {n}\n\nText of {n} that is long enough to be kept.\n", "src", f"/docs/{n}.md") for n in names]
    return spark.createDataFrame(rows, "name string, size long, content string, source string, path string")


def _paths(spark, root):
    return sorted(r.path for r in ingest.collection(spark, root).select("path").distinct().collect())


def test_a_retry_loses_no_file(spark, tmp_path):
    root = str(tmp_path)

    def picky():
        def run(texts):
            if any("Text of b" in t for t in texts):
                raise ValueError("no")
            return np.ones((len(texts), 4), np.float32)

        return run

    ingest.embed_batch(_files(spark, "a"), 0, root, "headers", embed=vc.careful_embedder(picky, wait=0))
    ingest.embed_batch(_files(spark, "b"), 1, root, "headers", embed=vc.careful_embedder(picky, wait=0))
    assert _paths(spark, root) == ["/docs/a.md"]
    ingest.retry_dead_letters(spark, root, 2)
    assert _paths(spark, root) == ["/docs/a.md", "/docs/b.md"]
    ingest.embed_batch(_files(spark, "c"), 2, root, "headers")  # the stream's next batch has the retry's number
    assert _paths(spark, root) == ["/docs/a.md", "/docs/b.md", "/docs/c.md"]
    ingest.embed_batch(_files(spark, "c"), 2, root, "headers")  # run again
    assert _paths(spark, root) == ["/docs/a.md", "/docs/b.md", "/docs/c.md"] and len(versions(spark, f"{root}/vectors")) == 4
    before = sorted(r.chunk_id for r in ingest.collection(spark, root).collect())
    ingest.compact(spark, root)
    assert sorted(r.chunk_id for r in ingest.collection(spark, root).collect()) == before
    ingest.retry_dead_letters(spark, root, 3)
    assert sorted(r.chunk_id for r in ingest.collection(spark, root).collect()) == before
