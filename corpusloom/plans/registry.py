"""Queries by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is DuckDB's."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(text: str) -> str:
    """A DuckDB string."""
    return "'" + text.replace("'", "''") + "'"


def replaced(expression: str, rules: list[tuple[str, str]]) -> str:
    """Nested regexp_replace of (pattern, replacement) rules written for Java."""
    for pattern, to in rules:
        to = to.replace("\\", "\\\\")
        for k in range(1, 4):
            to = to.replace(f"${k}", f"\\{k}")
        expression = f"regexp_replace({expression}, {literal(pattern)}, {literal(to)}, 'g')"
    return expression
