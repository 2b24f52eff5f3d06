"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two map-side aggregated minima and a join with each, so a vertex
with very many edges is split by Spark's skew join and never gathered; the number of
rounds grows with the logarithm of the size (Kiveris et al. 2014). Each round's
edges are saved to shared storage, which ends the lineage.

Defined results: repeated edges count once, edges of a vertex with itself or with
a null not at all; no edges have no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's larger (or smaller) neighbours to the least of it and its neighbours."""
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Saved, so that both sides of the join are dealt out for it alone, which lets Spark split a frequent vertex.
    least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(vertex, root) of every vertex of ``edges`` (columns a and b, longs); the root is its component's least vertex."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = now.agg(mark.alias("x")).first().x
    for _ in range(rounds):
        now = saved(_star(_star(now, True), False), "edges")
        after = now.agg(mark.alias("x")).first().x
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
