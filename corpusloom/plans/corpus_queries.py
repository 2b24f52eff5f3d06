"""Queries of chunking, keywords, change tracking, retrieval, citations and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import cite
from corpusloom.functions.text import content_hash, dedupe_lines
from corpusloom.operators import chunk as ch
from corpusloom.operators import incremental as inc
from corpusloom.operators import keywords as kw
from corpusloom.operators import vectors as vc
from corpusloom.operators.conversation import answer, contexts, history, trimmed
from corpusloom.plans.registry import literal, query, table
from corpusloom.plans.text_queries import markdown
from corpusloom.session import scratch, small_batches
from corpusloom.streaming.ingest import conversation_memory, replayed

# ---------------------------------------------------------------- chunks


def _lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("units"))


#: Lines packed one after another; sums of lengths start anew where a line doesn't fit.
_GREEDY_SQL = """
u AS (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS units FROM documents),
r AS (SELECT doc_id, source, units, 1 AS i, 0 AS chunk_index, length(units[1]) AS total FROM u WHERE len(units) > 0
      UNION ALL SELECT doc_id, source, units, i + 1, CASE WHEN total + length(units[i + 1]) <= 1000 THEN chunk_index ELSE chunk_index + 1 END,
                       CASE WHEN total + length(units[i + 1]) <= 1000 THEN total + length(units[i + 1]) ELSE length(units[i + 1]) END FROM r WHERE i < len(units)),
g AS (SELECT doc_id, source, chunk_index, string_agg(units[i], ' ' ORDER BY i) AS content FROM r GROUP BY ALL)
"""


@query("chunk_greedy", f"WITH RECURSIVE {_GREEDY_SQL} SELECT doc_id, chunk_index, content FROM g")
def chunk_greedy(spark, sf):
    return _lines(spark, sf).select("doc_id", F.posexplode(ch.pack(F.col("units"))).alias("chunk_index", "content"))


@query("chunk_stats", f"WITH RECURSIVE {_GREEDY_SQL}, d AS (SELECT doc_id, source, count(*) AS n FROM g GROUP BY ALL) SELECT source, count(*) AS n_files, sum(n)::BIGINT AS n_chunks, max(n) AS most_chunks FROM d GROUP BY source")
def chunk_stats(spark, sf):
    rows = _lines(spark, sf).select("source", F.size(ch.pack(F.col("units"))).cast("long").alias("n")).where("n > 0")
    return rows.groupBy("source").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_chunks"), F.max("n").alias("most_chunks"))


def flagship(spark, sf):
    """Documents without repeated lines, in chunks, counted by source."""
    once = dedupe_lines(table(spark, sf, "documents"), "text", "once")
    units = F.filter(F.split("once", "\n"), lambda x: F.trim(x) != "")
    rows = once.select("source", F.explode(ch.pack(units)).alias("content"))
    return rows.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(ch.chunk_size()("text")).alias("chunk_index", "content"))


#: Sentences in place of lines, packed by the same rule; then short chunks that start as list items take in the next one that does.
_SENTENCES_SQL = _GREEDY_SQL.replace(
    "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')",
    r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')",
)
_ITEM_SQL = f"regexp_matches(c[%s], {literal(ch.LIST_ITEM)})"


@query(
    "chunk_sentences",
    f"""WITH RECURSIVE {_SENTENCES_SQL}, w AS (SELECT doc_id, list(content ORDER BY chunk_index) AS c FROM g GROUP BY doc_id),
m AS (SELECT doc_id, c, 1 AS i, 0 AS k, {_ITEM_SQL % 1} AND length(c[1]) < 500 AS open FROM w
      UNION ALL SELECT doc_id, c, i + 1, CASE WHEN open AND {_ITEM_SQL % 'i + 1'} THEN k ELSE k + 1 END, NOT (open AND {_ITEM_SQL % 'i + 1'}) AND {_ITEM_SQL % 'i + 1'} AND length(c[i + 1]) < 500 FROM m WHERE i < len(c))
SELECT doc_id, k AS chunk_index, string_agg(c[i], chr(10) ORDER BY i) AS content FROM m GROUP BY doc_id, k""",
)
def chunk_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(ch.sentence_chunks(F.col("text"))).alias("chunk_index", "content"))




def _headed():
    c, s = F.concat, F.lit
    return c(s("intro\n# "), F.col("source"), s("\nfirst part\n```\n# no header\n```\n### Deep\nmore\n## "), F.col("lang"), s("\n"), F.col("text"))


_SECTIONS_SQL = """
SELECT doc_id, s AS section, [NULL, source, source, source][s + 1] AS h1, [NULL, NULL, NULL, lang][s + 1] AS h2, [NULL, NULL, 'Deep', NULL][s + 1] AS h3,
       ['intro', '# ' || source || chr(10) || 'first part' || chr(10) || '```' || chr(10) || '# no header' || chr(10) || '```', '### Deep' || chr(10) || 'more', regexp_replace('## ' || lang || chr(10) || text, '\\s+$', '')][s + 1] AS content
FROM documents, (SELECT unnest([0, 1, 2, 3]) AS s)
"""


@query("chunk_headers", _SECTIONS_SQL)
def chunk_headers(spark, sf):
    small_batches(spark)
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(ch.chunk_headers(_headed())).alias("section", "x"))
    return rows.select("doc_id", "section", *[F.col(f"x.h{k}").alias(f"h{k}") for k in (1, 2, 3)], F.col("x.content").alias("content"))


@query("section_path", f"SELECT doc_id, section, nullif(concat_ws(' > ', h1, h2, h3), '') AS section_path FROM ({_SECTIONS_SQL})")
def section_path(spark, sf):
    rows = chunk_headers(spark, sf)
    return rows.select("doc_id", "section", cite.section_path(*[F.col(f"h{k}") for k in (1, 2, 3)]).alias("section_path"))


_ITEMS_SQL = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
t AS (SELECT doc_id, i, CASE WHEN i % 4 IN (1, 2) THEN '- ' ELSE '' END || line AS content FROM l)
"""


def _items(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.select("doc_id", "i", F.concat(F.when(F.col("i") % 4 < 1, "").when(F.col("i") % 4 < 3, "- ").otherwise(""), "line").alias("content"))


@query(
    "merge_list_chunks",
    f"""WITH {_ITEMS_SQL}, f AS (SELECT *, regexp_matches(content, {literal(ch.LIST_ITEM)}) AS item FROM t),
p AS (SELECT *, item AND coalesce(lag(item) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS goes_on FROM f),
g AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM p)
SELECT doc_id, min(i)::INT AS i, string_agg(content, chr(10) ORDER BY i) AS content FROM g GROUP BY doc_id, island""",
)
def merge_list_chunks(spark, sf):
    return ch.merge_lists(_items(spark, sf), "doc_id", "i", "content")


def _md_files(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), markdown(docs).alias("text"))


@query("chunk_pipeline")
def chunk_pipeline(spark, sf):
    return ch.chunk_documents(_md_files(spark, sf), strategy=ch.Strategy.HEADERS)


@query("chunk_pipeline_size")
def chunk_pipeline_size(spark, sf):
    return ch.chunk_documents(_md_files(spark, sf), strategy=ch.Strategy.SIZE)


@query("load_chunks", "SELECT doc_id, text AS page_content, source || '.jsonl' AS file FROM documents WHERE trim(text) <> ''")
def load_chunks(spark, sf):
    """Every text as a chunk, written as JSON lines by source and read back."""
    from corpusloom.sources.files import read_chunks, write_chunks

    folder = scratch(spark, "chunks")
    chunks = table(spark, sf, "documents").select(F.col("text").alias("page_content"), F.struct("doc_id").alias("metadata"), F.col("source").alias("cache_key"), F.col("doc_id").alias("chunk_index"))
    write_chunks(chunks, folder)
    name = F.concat(F.regexp_extract("file", "cache_key=([^/]*)/", 1), F.lit(".jsonl"))
    return read_chunks(spark, folder).select(F.col("metadata")["doc_id"].cast("long").alias("doc_id"), "page_content", name.alias("file"))


# ---------------------------------------------------------------- keywords
_STOP = ", ".join(literal(w) for w in kw.STOP_WORDS)


@query(
    "keywords_top",
    f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP})) AS w FROM documents WHERE length(trim(text)) >= 10),
c AS (SELECT doc_id, unnest(w) AS keyword FROM w UNION ALL SELECT doc_id, unnest(list_transform(w[: -2], lambda x, i: x || ' ' || w[i + 1])) FROM w),
n AS (SELECT doc_id, keyword, count(*) AS n FROM c GROUP BY ALL)
SELECT doc_id, keyword, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword)::INT AS rank FROM n QUALIFY rank <= 5""",
)
def keywords_top(spark, sf):
    return kw.top_keywords(table(spark, sf, "documents"), "doc_id", "text")


@query("keywords_maxsum")
def keywords_maxsum(spark, sf):
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", kw.max_sum_keywords()("text").alias("keywords"))


@query("keywords_mmr")
def keywords_mmr(spark, sf):
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", kw.marginal_keywords()("text").alias("keywords"))


# ---------------------------------------------------------------- change tracking
_CURRENT_SQL = "c AS (SELECT doc_id, source || '/' || doc_id AS cache_file, 1000.0 + doc_id AS mtime, n_chars AS size, sha256(text) AS content_hash, 2000.0 + doc_id AS jsonl_mtime FROM documents)"
_MANIFEST_SQL = """m AS (SELECT cache_file, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN mtime - 1 ELSE mtime END AS mtime, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE size END AS size,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'x' ELSE content_hash END AS content_hash, CASE WHEN doc_id % 2 = 0 THEN jsonl_mtime ELSE 0 END AS jsonl_mtime FROM c WHERE doc_id % 10 <> 0)"""


def _current(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("cache_file"), (1000.0 + F.col("doc_id")).alias("mtime"), F.col("n_chars").alias("size"), content_hash(F.col("text")).alias("content_hash"), (2000.0 + F.col("doc_id")).alias("jsonl_mtime"))


def _manifest(current):
    known = lambda k: F.col("doc_id") % k == 0
    return current.where(~known(10)).select(
        "cache_file", F.when(known(11), None).when(known(3), F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), F.when(~known(11), F.col("size")).alias("size"),
        F.when(known(11), None).when(known(7), "x").otherwise(F.col("content_hash")).alias("content_hash"), F.when(known(2), F.col("jsonl_mtime")).otherwise(0.0).alias("jsonl_mtime"),
    )


@query(
    "chunk_cache_status",
    f"""WITH {_CURRENT_SQL}, {_MANIFEST_SQL} SELECT c.cache_file, CASE WHEN m.cache_file IS NULL THEN 'new' WHEN c.mtime = m.mtime AND c.size = m.size THEN 'unchanged'
  WHEN c.content_hash = m.content_hash THEN 'touched' ELSE 'changed' END AS status FROM c LEFT JOIN m USING (cache_file)""",
)
def chunk_cache_status(spark, sf):
    current = _current(spark, sf)
    return inc.cache_status(current, _manifest(current), "cache_file").select("cache_file", "status")


@query(
    "changed_files",
    f"""WITH {_CURRENT_SQL}, {_MANIFEST_SQL}, s AS (SELECT c.cache_file, CASE WHEN m.cache_file IS NULL THEN 'new'
  WHEN m.mtime IS NOT NULL AND m.size IS NOT NULL AND m.content_hash IS NOT NULL THEN CASE WHEN (c.mtime <> m.mtime OR c.size <> m.size) AND c.content_hash <> m.content_hash THEN 'modified' END
  WHEN m.jsonl_mtime IS DISTINCT FROM c.jsonl_mtime THEN 'modified' END AS status FROM c LEFT JOIN m USING (cache_file)) SELECT * FROM s WHERE status IS NOT NULL""",
)
def changed_files(spark, sf):
    current = _current(spark, sf)
    return inc.changed_files(current, _manifest(current))


@query("deleted_files", "SELECT 'gone/' || doc_id AS cache_file FROM documents WHERE doc_id % 10 = 1")
def deleted_files(spark, sf):
    current = _current(spark, sf)
    gone = current.where("doc_id % 10 = 1").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("cache_file"))
    return inc.deleted_files(current, current.select("cache_file").union(gone)).select("cache_file")


@query("delete_by_source", "SELECT vec_id, label FROM embeddings WHERE label % 3 <> 0")
def delete_by_source(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.concat(F.lit("f"), F.col("label").cast("string")).alias("file_path"))
    return inc.delete_by_source(rows, rows.where("label % 3 = 0").select("file_path")).select("vec_id", "label")


@query("delete_by_substring", "SELECT vec_id FROM embeddings WHERE NOT contains('f' || label, '1')")
def delete_by_substring(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("f"), F.col("label").cast("string")).alias("file_path"))
    return inc.delete_by_source(rows, spark.createDataFrame([("1",)], "file_path string"), substring=True).select("vec_id")


@query("upsert_vectors", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 5 = 0")
def upsert_vectors(spark, sf):
    old = table(spark, sf, "embeddings").select("vec_id", "label")
    new = old.where("vec_id % 4 = 0").select("vec_id", (F.col("label") + 100).alias("label")).union(old.where("vec_id % 5 = 0").select(F.col("vec_id") + 1000000, "label"))
    return inc.upsert(old, new.union(new), "vec_id")


@query("dead_letter_retry", "SELECT doc_id AS chunk_id, (1 + doc_id % 2 + 1)::INT AS attempt FROM documents WHERE doc_id % 9 = 0 AND 1 + doc_id % 2 < 3")
def dead_letter_retry(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    dead = chunks.where("chunk_id % 9 = 0").select("chunk_id", F.explode(F.sequence(F.lit(1), (1 + F.col("chunk_id") % 2).cast("int"))).alias("attempt"))
    exhausted = chunks.where("chunk_id % 9 = 1").select("chunk_id", F.lit(3).alias("attempt"))
    return inc.retryable(dead.union(exhausted), chunks).select("chunk_id", "attempt")


@query("batch_assign", "SELECT doc_id, (floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) + 1)::BIGINT AS batch_no FROM documents")
def batch_assign(spark, sf):
    return inc.assign_batches(table(spark, sf, "documents").select("doc_id"), "doc_id")


# ---------------------------------------------------------------- vectors
@query("embed_docs")
def embed_docs(spark, sf):
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", vc.embedder()("text").alias("embedding"))


@query(
    "vector_topk",
    "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 9) DESC, vec_id LIMIT 4",
)
def vector_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    asked = rows.orderBy("vec_id").select("embedding").first()[0]
    return vc.topk(rows, asked).select("vec_id", F.round("score", 6).alias("score"))


_HITS_SQL = """h AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
k AS (SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM h QUALIFY rank <= 4)"""


def _hits(spark, sf):
    rows = table(spark, sf, "embeddings")
    return vc.topk_batch(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


@query("vector_topk_batch", f"WITH {_HITS_SQL} SELECT * FROM k")
def vector_topk_batch(spark, sf):
    return _hits(spark, sf).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- citations
_MD_SQL = "m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'None' ELSE source END AS source, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Title ' || lang END AS title, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN '' ELSE 'https://x.example/' || doc_id END AS url, CASE WHEN doc_id % 3 = 0 THEN '7' END AS page, CASE WHEN doc_id % 2 = 0 THEN lang || ' > Part' END AS header FROM documents)"
_CITED_SQL = f"""{_MD_SQL}, n AS (SELECT doc_id, coalesce(nullif(source, 'None'), 'Unknown') || ': ' || coalesce(title, 'Unknown') AS name, url, page, header FROM m),
c AS (SELECT doc_id, regexp_replace('[' || doc_id || '] ' || name || ', ' || coalesce('Section: ' || header || ', ', '') || coalesce('URL: ' || url || ', ', '') || coalesce('Page: ' || page || ', ', ''), '[, ]+$', '') AS citation_text,
  '[' || doc_id || '] [' || name || '](' || url || ')' AS hyperlink_citation FROM n)"""


def _cited(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    url = F.when(i % 6 == 0, None).when(i % 6 == 1, "").otherwise(F.concat(F.lit("https://x.example/"), i.cast("string")))
    c = cite.citation(i, F.when(i % 5 == 0, "None").otherwise(F.col("source")), F.when(i % 4 != 0, F.concat(F.lit("Title "), "lang")), F.when(i % 2 == 0, F.concat("lang", F.lit(" > Part"))), url, F.when(i % 3 == 0, "7"), F.lit(None).cast("string"))
    return d.select("doc_id", "text", c.alias("c"))


@query("citations", f"WITH {_CITED_SQL} SELECT * FROM c")
def citations(spark, sf):
    return _cited(spark, sf).select("doc_id", "c.citation_text", "c.hyperlink_citation")


@query("citation_lines", f"WITH {_CITED_SQL} SELECT c.doc_id, coalesce(hyperlink_citation, citation_text) || chr(10) || text AS line FROM c JOIN documents USING (doc_id)")
def citation_lines(spark, sf):
    return _cited(spark, sf).select("doc_id", cite.citation_line(F.col("c"), F.col("text")).alias("line"))


@query(
    "header_chain",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ' > ' || source WHEN doc_id % 3 = 1 THEN source ELSE nullif(trim(text), '') END AS chain FROM documents""",
)
def header_chain(spark, sf):
    i, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    first = [F.when(i == 0, F.concat("lang", F.lit(" "))), F.when(i == 0, F.lit("  ")), F.when(i == 0, F.col("source")), F.when(i == 0, F.col("lang"))]
    other = [none, F.when(i == 1, F.col("source")), F.when(i == 1, F.col("source")), F.when(i == 1, "None")]
    return table(spark, sf, "documents").select("doc_id", cite.header_chain(first, other, F.col("text")).alias("chain"))


def _chunk_table(spark, sf):
    d = table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    return d.select(F.col("doc_id").alias("vec_id"), "source", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("header"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("url"), none.alias("page"), none.alias("file_path"), F.col("text").alias("page_content"))


_CONTEXT_SQL = f"""{_HITS_SQL}, x AS (SELECT query_id, rank, CASE WHEN doc_id % 2 = 0 THEN '[' || rank || '] [' || source || ': Doc ' || doc_id || '](u' || doc_id || ')' ELSE '[' || rank || '] ' || source || ': Doc ' || doc_id || ', Section: ' || lang END AS line,
  text AS content FROM k JOIN documents ON doc_id = vec_id),
a AS (SELECT query_id, string_agg(line || CASE WHEN content <> '' THEN chr(10) || content ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS context, '**Sources:**' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS sources FROM x GROUP BY query_id)"""


@query("rag_context", f"WITH {_CONTEXT_SQL} SELECT query_id, context FROM a")
def rag_context(spark, sf):
    return contexts(_hits(spark, sf), _chunk_table(spark, sf)).select("query_id", "context")


@query("sources_panel", f"WITH {_CONTEXT_SQL} SELECT query_id, sources FROM a")
def sources_panel(spark, sf):
    return contexts(_hits(spark, sf), _chunk_table(spark, sf)).select("query_id", "sources")


@query("rag_answer", f"WITH {_CONTEXT_SQL} SELECT query_id, 'Question ' || query_id || chr(10) || chr(10) || {literal(cite.INSTRUCTION)} || chr(10) || chr(10) || context AS prompt, coalesce(string_split(context, chr(10))[2], '') AS answer, sources FROM a")
def rag_answer(spark, sf):
    found = contexts(_hits(spark, sf), _chunk_table(spark, sf))
    questions = found.select("query_id", F.concat(F.lit("Question "), F.col("query_id").cast("string")).alias("question"))
    return answer(questions, found)


# ---------------------------------------------------------------- conversations
@query("conversation_history", "SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def conversation_history(spark, sf):
    return history(table(spark, sf, "conversations"))


@query(
    "conversation_trimmed",
    "WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn FROM t WHERE k = 1 OR n <= 3 OR k > n - CASE WHEN n % 2 = 0 THEN 3 ELSE 4 END",
)
def conversation_trimmed(spark, sf):
    return trimmed(table(spark, sf, "conversations").select("conv_id", "turn"))


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query("conversation_state", "SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def conversation_state(spark, sf):
    """The turns replayed as a stream, each conversation's number of turns kept as its state."""
    folder, path = scratch(spark, "conversation-state"), f"{sf}/conversations.parque[t]"  # a pattern, as a stream takes folders or patterns
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # the stream takes the setting with it when it starts
    try:
        turns = spark.readStream.schema(table(spark, sf, "conversations").schema).parquet(path)
        replayed(conversation_memory(turns, most=5, turn="turn"), f"{folder}/out", f"{folder}/checkpoint")
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema("conv_id long, n_turns long").parquet(f"{folder}/out").groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"))
