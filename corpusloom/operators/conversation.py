"""Retrieval-augmented answers over conversations: history, contexts, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.cite import citation, citation_line, in_order, panel, prompt


def history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, transcript): each conversation's turns in order."""
    line = F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    return turns.groupBy(conv).agg(F.count("*").alias("n_turns"), in_order(F.col(turn), line, "\n").alias("transcript"))


def trimmed(turns: DataFrame, last: int = 3, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The first and the ``last`` turns of each conversation; one more if their number is even."""
    by = Window.partitionBy(conv)
    rows = turns.withColumn("_k", F.row_number().over(by.orderBy(turn))).withColumn("_n", F.count("*").over(by))
    keep = F.when(F.col("_n") % 2 == 0, last).otherwise(last + 1)
    return rows.where((F.col("_k") == 1) | (F.col("_k") > F.col("_n") - keep) | (F.col("_n") <= last)).drop("_k", "_n")


def contexts(hits: DataFrame, chunks: DataFrame, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """(query, context, sources) of retrieved chunks: numbered citations with their contents, and the panel of sources.

    ``chunks``: key, source, title, header, url, page, file_path, page_content.
    """
    cited = citation(F.col("rank"), *[F.col(c) for c in ("source", "title", "header", "url", "page", "file_path")])
    rows = hits.join(chunks, key).withColumn("_c", cited)
    return rows.groupBy(query).agg(
        in_order(F.col("rank"), citation_line(F.col("_c"), F.col("page_content")), "\n\n").alias("context"),
        panel(in_order(F.col("rank"), citation_line(F.col("_c")), "\n")).alias("sources"),
    )


def answer(questions: DataFrame, found: DataFrame, generate: Callable[[Column], Column] | None = None, query: str = "query_id", text: str = "question") -> DataFrame:
    """(query, prompt, answer, sources); ``generate`` makes the answer from the prompt (by default the first line of the context)."""
    joined = questions.join(found, query, "left")
    full = prompt(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col("context"), F.lit("")))
    first = F.coalesce(F.get(F.split("context", "\n"), F.lit(1)), F.lit(""))
    rows = joined.withColumn("prompt", full)
    return rows.select(query, "prompt", (generate(F.col("prompt")) if generate else first).alias("answer"), F.coalesce("sources", panel(F.lit(None).cast("string"))).alias("sources"))
