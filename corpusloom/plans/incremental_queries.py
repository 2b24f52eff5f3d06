"""Queries of the chunk store, deletes by parts of paths, and the vector index: what is written, read back and searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import chunk_store as cs
from corpusloom.operators import incremental as inc
from corpusloom.operators import vector_index as vi
from corpusloom.operators import vectors as vc
from corpusloom.operators.chunk import Strategy
from corpusloom.plans.corpus_queries import _SECTIONS_SQL, _headed
from corpusloom.plans.registry import query, table
from corpusloom.session import scratch

# ---------------------------------------------------------------- chunk store
_STORE_SQL = f"""
WITH now AS (
  SELECT doc_id, lang, source, doc_id % 7 = 0 AND doc_id % 10 <> 0 AS edited, doc_id % 3 = 0 OR (doc_id % 7 = 0 AND doc_id % 10 <> 0) AS moved,
         CASE WHEN doc_id % 7 = 0 AND doc_id % 10 <> 0 THEN text || ' more' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1),
sections AS ({_SECTIONS_SQL.replace("FROM documents", "FROM now")}),
whole AS (SELECT *, 'intro' || chr(10) || '# ' || source || chr(10) || 'first part' || chr(10) || '```' || chr(10) || '# no header' || chr(10) || '```' || chr(10) || '### Deep' || chr(10) || 'more' || chr(10) || '## ' || lang || chr(10) || text AS content FROM now)
SELECT source || '/' || doc_id || '.md' AS path, section AS chunk_index, s.content AS page_content, 1000.0::DOUBLE + doc_id + CASE WHEN moved THEN 1 ELSE 0 END AS mtime,
       length(w.content)::BIGINT AS size, sha256(w.content) AS content_hash, 4::BIGINT AS num_chunks, CASE WHEN edited OR doc_id % 10 = 0 THEN 1 ELSE 0 END::BIGINT AS version,
       CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN edited THEN 'changed' WHEN moved THEN 'touched' ELSE 'new' END AS status
FROM whole w JOIN sections s USING (doc_id)
"""


@query("chunk_incremental", _STORE_SQL)
def chunk_incremental(spark, sf):
    """Two runs over all documents as files: the second finds some new, edited, touched or gone; the store's chunks then, with their manifest."""
    root, settings = scratch(spark, "chunk-store"), cs.Settings(Strategy.HEADERS, 1 << 30, 0, keywords=False)
    docs, k = table(spark, sf, "documents"), F.col("doc_id")
    edited = (k % 7 == 0) & (k % 10 != 0)

    def files(rows, mtime):
        path = F.concat("source", F.lit("/"), k.cast("string"), F.lit(".md"))
        return rows.select(path.alias("path"), mtime.alias("mtime"), _headed().alias("content")).withColumn("size", F.length("content").cast("long"))

    cs.chunk_incremental(files(docs.where(k % 10 != 0), 1000.0 + k), root, settings)
    later = docs.where(k % 10 != 1).withColumn("text", F.when(edited, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    cs.chunk_incremental(files(later, 1000.0 + k + F.when(edited | (k % 3 == 0), 1).otherwise(0)), root, settings, drop_deleted=True)
    about = ("mtime", "size", "content_hash", "num_chunks", "status")
    return cs.chunks(spark, root, about=about).select("path", "chunk_index", "page_content", "version", *about)


# ---------------------------------------------------------------- deletes by a part of the path
@query(
    "delete_by_parts",
    """WITH p AS (SELECT '/' || doc_id || '.' AS part FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT source || '/' || doc_id FROM documents WHERE doc_id % 90 = 7 UNION ALL SELECT doc_id::VARCHAR FROM documents WHERE doc_id % 450 = 13 UNION ALL SELECT 'no such path' UNION ALL SELECT NULL)
SELECT doc_id, source || '/' || doc_id || '.md' AS file_path FROM documents d WHERE NOT EXISTS (SELECT 1 FROM p WHERE contains(d.source || '/' || d.doc_id || '.md', part))""",
)
def delete_by_parts(spark, sf):
    """Chunks named by the documents' paths; a twentieth of the documents, and some more, give parts of paths to delete."""
    docs, k = table(spark, sf, "documents"), F.col("doc_id")
    text = k.cast("string")
    rows = docs.select("doc_id", F.concat("source", F.lit("/"), text, F.lit(".md")).alias("file_path"))
    parts = docs.where(k % 20 == 0).select(F.concat(F.lit("/"), text, F.lit(".")).alias("file_path")).union(docs.where(k % 90 == 7).select(F.concat("source", F.lit("/"), text)))
    parts = parts.union(docs.where(k % 450 == 13).select(text)).union(spark.createDataFrame([("no such path",), (None,)], "file_path string"))
    return inc.delete_by_source(rows, parts, substring=True)


# ---------------------------------------------------------------- vector index
def _ann(spark, sf):
    rows = table(spark, sf, "embeddings")
    index = vi.build(rows, scratch(spark, "vector-index"))
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return rows, asked, vi.search(index, asked)


@query("vector_ann")
def vector_ann(spark, sf):
    """The four nearest vectors that the index finds for every vector whose id is divisible by 50."""
    return _ann(spark, sf)[2].select("query_id", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("vector_ann_recall", "SELECT count(*) AS n_queries, TRUE AS recalled FROM embeddings WHERE vec_id % 50 = 0")
def vector_ann_recall(spark, sf):
    """Whether at least 0.95 of the exact neighbours of these queries are found by the index."""
    rows, asked, found = _ann(spark, sf)
    exact = vc.topk_batch(rows, asked).select("query_id", "vec_id")
    both = found.select("query_id", F.col("key").alias("vec_id"), F.lit(1).alias("hit"))
    share = exact.join(both, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.95).alias("recalled"))
    return share
