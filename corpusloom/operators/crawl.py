"""Reachability over a table of links, in levels.

A level is a join of the frontier with the links and an anti-join with what has
been visited; both shuffle by url. A visited table is saved when the frontier
turns, so the lineage stays short; cyclic graphs end when nothing new appears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import scratch, stored


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(url, depth) of every page reached from ``seeds`` (url) over ``links`` (src, dst); depth is the least."""
    spark = links.sparkSession
    folder = scratch(spark, "crawl")

    def level(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{folder}/depth={k}")
        return spark.read.schema("url string").parquet(f"{folder}/depth={k}")

    edges = stored(links.select("src", "dst").where("src <> dst").distinct(), "edges")  # once, not at each level
    frontier = visited = level(seeds.select("url").where("url IS NOT NULL").distinct(), 0)
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        found = frontier.join(edges, frontier["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        frontier = level(found.join(visited, "url", "left_anti"), depth)
        visited = spark.read.schema("url string, depth int").parquet(folder).select("url")
    return spark.read.schema("url string, depth int").parquet(folder)
