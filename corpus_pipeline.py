"""The corpus pipeline: quality, near duplicates, benchmark passages, mixture, token files.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's docs. All but the last return the columns of
documents. It needs the training-data operators and goes with them.

Defined results are those of the operators: a null or empty text is judged by the
quality classifier like any other, is its own class, holds no benchmark passage,
and becomes its end id alone; of equal texts one stays; rows with null ids are
documents each; of ties the least id, then the least place stays; an empty table
gives no row and no file; a very long text is one row of each stage. Extra columns
of the documents, of whatever names, go with their rows up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, jaccard_join, mixing, quality, token_codes
from corpusloom.llm._shared import read_table, saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents stay, once each; of the others each stays, once at most, as its rate says."""
    return mixing.mix(docs, read_table(spark, sf_dir, "labels"))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The files' documents: doc_id, start, n_tokens, ids_crc32."""
    return token_codes.tokens_of(docs, token_codes.tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontamination", drop_benchmark),
    ("mixing", mix_domains),
    ("token_files", write_token_files),
]

#: The classifiers, the components and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
