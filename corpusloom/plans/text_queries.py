"""Queries of the text, frontmatter, file-name and repair operators.

The document table has neither frontmatter nor headings, so queries that need
them make such documents from its rows, alike in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import frontmatter as fm
from corpusloom.functions import repair
from corpusloom.functions import text as tx
from corpusloom.functions.yaml_front import typed, with_typed_frontmatter
from corpusloom.operators.clean import clean_documents, clean_stats, update_frontmatter
from corpusloom.plans.registry import literal, query, table
from corpusloom.session import small_batches

# ---------------------------------------------------------------- made-up files
_NAMES = ["File:a.md", "x.tar.gz", "tagetes.md", ".initial.md", "wikiPage.md", "Photo.PNG", "Special:all.md", "plain.md", "empty.md", "notes.txt", "one-community-welcomes.md", "wiki.md"]


def file_names(docs: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, _NAMES))
    return docs.select("doc_id", F.element_at(names, (F.col("doc_id") % len(_NAMES) + 1).cast("int")).alias("name"), F.when(F.col("doc_id") % len(_NAMES) == 8, 0).otherwise(F.col("n_chars")).cast("long").alias("size"))


FILE_NAMES_SQL = f"(SELECT doc_id, ([{', '.join(map(literal, _NAMES))}])[(doc_id % {len(_NAMES)} + 1)::INT] AS name, CASE WHEN doc_id % {len(_NAMES)} = 8 THEN 0 ELSE n_chars END::BIGINT AS size, text FROM documents)"


def markdown(docs: DataFrame) -> Column:
    """A document with frontmatter, headings, a repeated line and a tail of boilerplate."""
    c, s = F.concat, F.lit
    return c(
        s("---\nsource: "), F.col("source"), s("\ntitle: \"Doc: "), F.col("doc_id").cast("string"), s("\"\nurl: https -//x.example/"), F.col("lang"), s("\n## note: no\nlicense: CC BY 4.0\ncustom: 1\n---\n\n"),
        F.col("lang"), s("\n====\nsame line\n"), F.col("text"), s("\nsame line\n\nPart\n----\n- item\n"), F.when(F.col("doc_id") % 3 == 0, "Retrieved from somewhere\nNavigation menu").otherwise(""),
    )


MARKDOWN_SQL = (
    "('---' || chr(10) || 'source: ' || source || chr(10) || 'title: \"Doc: ' || doc_id || '\"' || chr(10) || 'url: https -//x.example/' || lang || chr(10) || '## note: no' || chr(10) || 'license: CC BY 4.0' || chr(10) || 'custom: 1' || chr(10) || '---' || chr(10) || chr(10)"
    " || lang || chr(10) || '====' || chr(10) || 'same line' || chr(10) || text || chr(10) || 'same line' || chr(10) || chr(10) || 'Part' || chr(10) || '----' || chr(10) || '- item' || chr(10)"
    " || CASE WHEN doc_id % 3 = 0 THEN 'Retrieved from somewhere' || chr(10) || 'Navigation menu' ELSE '' END)"
)
_BODY_SQL = f"string_split({MARKDOWN_SQL}, '---')"


def _md(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.withColumn("md", markdown(docs))


# ---------------------------------------------------------------- files
@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query("file_stats", "SELECT doc_id, strlen(text)::BIGINT AS size, 1.7e9 + doc_id * 60 AS mtime FROM documents")
def file_stats(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), (F.lit(1.7e9) + F.col("doc_id") * 60).alias("mtime"))


def _reject_sql(name: str, size: str) -> str:
    whens = [f"WHEN {size} = 0 THEN 'empty file'", *[f"WHEN contains({name}, {literal(t)}) THEN {literal('disallowed page type: ' + t)}" for t in tx.PAGE_TYPES]]
    whens += [f"WHEN contains(lower({name}), {literal(t)}) THEN {literal('disallowed file type: ' + t)}" for t in tx.FILE_TYPES]
    return f"CASE {' '.join(whens)} WHEN {name}[1:3] = 'tag' THEN 'tag file' END"


@query("file_reject_reason", f"SELECT doc_id, name, {_reject_sql('name', 'size')} AS reason, ends_with(name, '.md') AS is_markdown FROM {FILE_NAMES_SQL}")
def file_reject_reason(spark, sf):
    files = file_names(table(spark, sf, "documents"))
    return files.select("doc_id", "name", tx.reject_reason(F.col("name"), F.col("size")).alias("reason"), tx.is_markdown(F.col("name")).alias("is_markdown"))


@query("wiki_rename", f"SELECT new_name, count(*) AS n_files, count(DISTINCT name) AS n_names FROM (SELECT name, CASE WHEN starts_with(name, 'wiki') THEN name[5:] ELSE name END AS new_name FROM {FILE_NAMES_SQL}) GROUP BY new_name")
def wiki_rename(spark, sf):
    renamed = file_names(table(spark, sf, "documents")).withColumn("new_name", tx.wiki_rename(F.col("name")))
    return renamed.groupBy("new_name").agg(F.count("*").alias("n_files"), F.count_distinct("name").alias("n_names"))


@query("cache_key", "SELECT doc_id, source || '/' || regexp_replace(lang || '.' || doc_id || '.md', '\\.[^.]*$', '') AS cache_key FROM documents")
def cache_key(spark, sf):
    path = F.concat(F.lit("data/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("."), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf, "documents").select("doc_id", tx.cache_key(path).alias("cache_key"))


@query("url_to_filename", r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[^\w\-_.]', '_', 'g') || '.md' AS file_name FROM pages")
def url_to_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.url_to_filename(F.col("url")).alias("file_name"))


# ---------------------------------------------------------------- text
_BOILER_SQL = f"string_split_regex({{0}}, {literal('|'.join(tx.BOILERPLATE))})"


def _boiler_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {literal('|'.join(tx.BOILERPLATE))}) THEN regexp_replace(({_BOILER_SQL.format(x)})[1], '^\\s+|\\s+$', '', 'g') ELSE {x} END"


@query("remove_boilerplate", f"WITH m AS (SELECT doc_id, {MARKDOWN_SQL} AS md FROM documents) SELECT doc_id, {_boiler_sql('md')} AS text FROM m")
def remove_boilerplate(spark, sf):
    return _md(spark, sf).select("doc_id", tx.remove_boilerplate(F.col("md")).alias("text"))


@query(
    "dedupe_lines",
    # Lines are compared in a table of their own: as lists the work would grow with the square of a text's lines.
    "WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS i FROM documents), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') ORDER BY i) AS n FROM l), "
    "d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k WHERE n = 1 GROUP BY doc_id) "
    "SELECT doc_id, d.text, d.text <> documents.text AS changed FROM d JOIN documents USING (doc_id)",
)
def dedupe_lines(spark, sf):
    out = tx.dedupe_lines(table(spark, sf, "documents"), "text", "once")
    return out.select("doc_id", F.col("once").alias("text"), (F.col("once") != F.col("text")).alias("changed"))




@query("standardize_headings", f"SELECT doc_id, regexp_replace(regexp_replace(md, '(?m)^(.+)\\n=+', '# \\1', 'g'), '(?m)^(.+)\\n-+', '## \\1', 'g') AS text FROM (SELECT doc_id, {MARKDOWN_SQL} AS md FROM documents)")
def standardize_headings(spark, sf):
    return _md(spark, sf).select("doc_id", tx.standardize_headings(F.col("md")).alias("text"))


@query(
    "strip_lines",
    f"SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text || chr(10) || '  ' || chr(10) || 'Generated by pymupdf4llm 1' || chr(10) || 'end  ', chr(10)), lambda l: trim(l) <> '' AND NOT contains(l, {literal(tx.CONVERTER_LINE)})), lambda l: regexp_replace(l, '\\s+$', '')), chr(10)) AS text FROM documents",
)
def strip_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.strip_lines(F.concat("text", F.lit("\n  \nGenerated by pymupdf4llm 1\nend  "))).alias("text"))


@query(
    "dedupe_description",
    """WITH d AS (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN w || w ELSE w END, ' ') AS p, CASE WHEN doc_id % 2 = 0 THEN w || w ELSE w END AS t
       FROM (SELECT doc_id, text AS w FROM documents)),
  s AS (SELECT *, coalesce(list_position(p, p[-1] || p[1]), 0) AS k FROM d)
  SELECT doc_id, CASE WHEN k > 0 THEN array_to_string(list_append(p[1 : k - 1], p[-1]), ' ') ELSE t END AS description FROM s""",
)
def dedupe_description(spark, sf):
    given = F.when(F.col("doc_id") % 2 == 0, F.concat("text", "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").withColumn("given", given).select("doc_id", tx.dedupe_description(F.col("given")).alias("description"))


@query("lang_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def lang_filter(spark, sf):
    from corpusloom.sources.web import of_languages

    return table(spark, sf, "documents").where(of_languages(F.col("lang"), ["en", "de"])).select("doc_id", "lang")


# ---------------------------------------------------------------- frontmatter
@query(
    "parse_frontmatter",
    f"SELECT doc_id, source, 'Doc - ' || doc_id AS title, 'https://x.example/' || lang AS url, 'CC BY 4.0' AS license, ['source', 'title', 'url', 'license', 'custom'] AS keys, array_to_string(({_BODY_SQL})[3:], '---') AS body FROM documents",
)
def parse_frontmatter(spark, sf):
    rows = _md(spark, sf).select("doc_id", fm.parse(F.col("md")).alias("x"))
    return rows.select("doc_id", *[fm.get(F.col("x.entries"), k).alias(k) for k in ("source", "title", "url", "license")], F.transform("x.entries", lambda p: p["key"]).alias("keys"), F.col("x.body").alias("body"))


@query("build_frontmatter", "SELECT doc_id, 'source: ' || source || chr(10) || 'title: Doc - ' || doc_id || chr(10) || 'url: https://x.example/' || lang || chr(10) || 'license: CC BY 4.0' || chr(10) || 'custom: 1' AS frontmatter FROM documents")
def build_frontmatter(spark, sf):
    return _md(spark, sf).select("doc_id", fm.build(fm.parse(F.col("md"))["entries"]).alias("frontmatter"))


@query(
    "canonical_frontmatter",
    "SELECT doc_id, 'source: ' || replace(lang || '_' || source, '_', ' ') || chr(10) || 'title: Doc - ' || doc_id || chr(10) || 'url: https://x.example/' || lang || chr(10) || 'license: CC BY 4.0' AS frontmatter, ['source'] AS updated_fields FROM documents",
)
def canonical_frontmatter(spark, sf):
    rows = _md(spark, sf).select("doc_id", fm.parse(F.col("md"))["entries"].alias("e"), F.concat("lang", F.lit("_"), "source").alias("folder"))
    rows = rows.withColumn("new", fm.canonical(F.col("e"), F.col("folder")))
    return rows.select("doc_id", fm.build(F.col("new")).alias("frontmatter"), fm.changed_keys(F.col("e"), F.col("new")).alias("updated_fields"))


@query(
    "extract_frontmatter",
    f"WITH m AS (SELECT doc_id, {MARKDOWN_SQL} AS md FROM documents) SELECT doc_id, regexp_extract(md, '(?s)^---\\s*\\n(.*?)\\n---\\s*\\n', 1) AS block, regexp_replace(md, '(?s)^---\\s*\\n(.*?)\\n---\\s*\\n', '') AS body FROM m",
)
def extract_frontmatter(spark, sf):
    return _md(spark, sf).select("doc_id", fm.extract(F.col("md")).alias("x")).select("doc_id", "x.block", "x.body")


def _broken(docs: DataFrame) -> Column:
    first = F.split("text", "\n")[0]
    return F.concat(F.lit("---\nsource: "), F.col("source"), F.lit("\ntitle: A title that\n---\ngoes on\nauthor: ''\nurl: https://x.example/"), F.col("doc_id").cast("string"), F.lit("\n## description: ''\n"), first, F.lit("\n"), F.col("text"))


@query("fix_yaml_delims")
def fix_yaml_delims(spark, sf):
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", fm.fix_yaml_delimiters(_broken(None)).alias("text"))


@query("fix_frontmatter")
def fix_frontmatter(spark, sf):
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", fm.fix_frontmatter(_broken(None)).alias("x")).select("doc_id", "x.frontmatter", "x.body")


# ---------------------------------------------------------------- repair
@query("fix_spaces")
def fix_spaces(spark, sf):
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", repair.fix_spaces(F.col("text")).alias("text"))


@query("fix_spaces_aggr")
def fix_spaces_aggr(spark, sf):
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", repair.fix_spaces_boldly(F.col("text")).alias("text"))


@query("fix_tables")
def fix_tables(spark, sf):
    small_batches(spark)
    broken = F.concat(F.lit("| Smith (2001) Jones (1999) | b | c |\n|---|---|---|\n| | "), F.split("text", "[|\n]")[0], F.lit(" | x |\n| | y | z |\n| | more | |\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", repair.fix_tables(["Citation", "Text"])(broken).alias("text"))


# ---------------------------------------------------------------- the cleaning pipeline
def _files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return file_names(docs).join(docs.select("doc_id", markdown(docs).alias("content")), "doc_id")


_CLEAN_SQL = f"""
WITH f AS (SELECT doc_id, name, size, {MARKDOWN_SQL} AS md, {_reject_sql('name', 'size')} AS reason,
                  array_to_string(({_BODY_SQL})[3:], '---') AS body, source, lang FROM (SELECT f.doc_id, f.name, f.size, d.text, d.source, d.lang FROM {FILE_NAMES_SQL} f JOIN documents d USING (doc_id))),
p AS (SELECT *, reason IS NULL AND ends_with(name, '.md') AS todo, {_boiler_sql('body')} AS plain FROM f),
l AS (SELECT doc_id, unnest(string_split(regexp_replace(plain, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(plain, '\\n$', ''), chr(10)), 1) AS i FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') ORDER BY i) AS n FROM l),
o AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS once FROM k WHERE n = 1 GROUP BY doc_id),
h AS (SELECT p.*, once, regexp_replace(regexp_replace(once, '(?m)^(.+)\\n=+', '# \\1', 'g'), '(?m)^(.+)\\n-+', '## \\1', 'g') AS heads FROM p JOIN o USING (doc_id)),
c AS (SELECT *, CASE WHEN todo THEN '---' || chr(10) || 'source: ' || source || chr(10) || 'title: Doc - ' || doc_id || chr(10) || 'url: https://x.example/' || lang || chr(10) || 'license: CC BY 4.0' || chr(10) || 'custom: 1' || chr(10) || '---' || chr(10) || regexp_replace(heads, '^\\n', '') ELSE md END AS cleaned,
             CASE WHEN todo AND starts_with(name, 'wiki') THEN name[5:] ELSE name END AS new_name FROM h),
a AS (SELECT doc_id, name, reason IS NOT NULL AS removed, reason, CASE WHEN reason IS NULL AND NOT ends_with(name, '.md') THEN 'Not a markdown file' END AS skipped, new_name, cleaned, todo AND cleaned <> md AS modified,
             list_filter([CASE WHEN todo AND plain <> body THEN 'removed_boilerplate' END, CASE WHEN todo AND rtrim(once, chr(10)) <> rtrim(plain, chr(10)) THEN 'removed_duplicates' END,
                          CASE WHEN todo AND heads <> once THEN 'standardized_headings' END, CASE WHEN todo AND new_name <> name THEN 'renamed_wiki' END], lambda x: x IS NOT NULL) AS changes FROM c)
"""


@query("clean_docs", _CLEAN_SQL + "SELECT * FROM a")
def clean_docs(spark, sf):
    return clean_documents(_files(spark, sf)).drop("size", "content")


@query(
    "clean_stats",
    _CLEAN_SQL + "SELECT count(*) AS total_files, count_if(removed)::BIGINT AS removed, count_if(modified AND NOT removed)::BIGINT AS modified, count_if(list_contains(changes, 'renamed_wiki'))::BIGINT AS renamed, count_if(skipped IS NOT NULL)::BIGINT AS skipped FROM a",
)
def clean_stats_query(spark, sf):
    return clean_stats(clean_documents(_files(spark, sf)))


@query("frontmatter_stats", "SELECT count(*) AS total_files, count_if(TRUE)::BIGINT AS modified, 0::BIGINT AS skipped, count(*)::BIGINT AS updated_sources FROM documents")
def frontmatter_stats(spark, sf):
    docs = table(spark, sf, "documents")
    files = docs.select("doc_id", markdown(docs).alias("content"), F.concat("lang", F.lit("_"), "source").alias("folder"))
    out = update_frontmatter(files, source="folder")
    return out.agg(F.count("*").alias("total_files"), F.count_if(F.col("modified")).cast("long").alias("modified"), F.count_if(F.col("updated").isNull()).cast("long").alias("skipped"), F.count_if(F.array_contains("updated_fields", "source")).cast("long").alias("updated_sources"))


# ---------------------------------------------------------------- frontmatter of kinds
def _yaml_documents(docs: DataFrame) -> Column:
    """Documents with numbers, a date, a list and nested maps before them; every tenth block is broken."""
    c, s, k = F.concat, F.lit, F.col("doc_id").cast("string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("string")
    title = F.when(F.col("doc_id") % 10 == 3, s("title: [open")).otherwise(c(s('title: "Doc: '), k, s('"')))
    return c(s("---\n"), title, s("\ndate: "), day, s("\ntags: ["), F.col("lang"), s(", "), F.col("source"), s("]\nplace:\n  id: "), k, s("\n  in: {share: 0.5, deep: [1, 2]}\n---\n"), F.col("text"))


@query(
    "typed_frontmatter",
    """SELECT doc_id, CASE WHEN NOT b THEN 'Doc: ' || doc_id END AS title, CASE WHEN NOT b THEN (DATE '2024-01-01' + (doc_id % 365)::INT)::DATE END AS day, CASE WHEN NOT b THEN [lang, source] END AS tags,
  CASE WHEN NOT b THEN doc_id END::BIGINT AS place, CASE WHEN NOT b THEN 0.5::DOUBLE END AS share, CASE WHEN NOT b THEN 2::BIGINT END AS second, b AS broken, text AS body FROM (SELECT *, doc_id % 10 = 3 AS b FROM documents)""",
)
def typed_frontmatter(spark, sf):
    docs = table(spark, sf, "documents")
    rows = with_typed_frontmatter(docs.select("doc_id", _yaml_documents(docs).alias("md")), "md")
    v = F.col("front.value")
    return rows.select(
        "doc_id", typed(v, "$.title", "string").alias("title"), typed(v, "$.date", "date").alias("day"), typed(v, "$.tags", "array<string>").alias("tags"), typed(v, "$.place.id", "bigint").alias("place"),
        typed(v, "$.place.in.share", "double").alias("share"), typed(v, "$.place.in.deep[1]", "bigint").alias("second"), F.col("front.error").isNotNull().alias("broken"), F.col("front.body").alias("body"),
    )
