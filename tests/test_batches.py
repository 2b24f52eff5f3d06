"""What queries hand to Python comes in batches of bounded rows and bytes."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import corpus_queries, incremental_queries, text_queries, web_queries  # noqa: F401  registers the queries
from corpusloom.plans.registry import QUERIES
from corpusloom.session import BATCH_BYTES, BATCH_ROWS, small_batches

ROWS, BYTES = (f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes"))


@pytest.fixture
def plain(spark):
    """The session with Spark's own bounds, before and after."""

    def unset():
        for name in (ROWS, BYTES):
            spark.conf.unset(name)

    unset()
    yield spark
    unset()


def largest(spark, length):
    """(rows, characters) of the largest batch of a task with 5000 texts of that length."""

    @F.pandas_udf("struct<rows: long, chars: long>")
    def seen(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rows": [len(c)] * len(c), "chars": [int(c.str.len().sum())] * len(c)})

    found = spark.range(0, 5000, 1, 1).select(seen(F.repeat(F.lit("x"), length)).alias("s"))
    return tuple(found.agg(F.max("s.rows"), F.max("s.chars")).first())


@pytest.mark.parametrize("name", ["page_reader", "page_markdown", "chunk_recursive", "chunk_headers", "section_path", "chunk_incremental", "chunk_pipeline", "chunk_pipeline_size", "keywords_top", "keywords_maxsum", "keywords_mmr"])
def test_batches_of_queries(plain, sf, name):
    QUERIES[name](plain, sf)
    assert largest(plain, 10)[0] <= BATCH_ROWS
    assert largest(plain, 100_000)[1] <= BATCH_BYTES + 1_000_000  # the bound is looked at after some rows


def test_smaller_bounds_stay(plain):
    plain.conf.set(ROWS, "7")
    plain.conf.set(BYTES, "1000")
    small_batches(plain)
    assert (plain.conf.get(ROWS), plain.conf.get(BYTES)) == ("7", "1000")
