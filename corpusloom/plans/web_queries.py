"""Queries of the HTML, link and crawl operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html as ht
from corpusloom.functions import links as ln
from corpusloom.functions.html_reader import page
from corpusloom.operators.crawl import crawl
from corpusloom.plans.registry import literal, query, replaced, table
from corpusloom.session import small_batches
from corpusloom.sources.web import robots_gate

_ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
_HREFS = "regexp_extract_all(html, '(?is)<a\\s(?:[^>]*\\s)?href=\"([^\"]*)\"', 1)"
#: All links of the test pages start at the root.
_LINKS = f"(SELECT page_id, url, {_ROOT} || '/' AS base, {_ROOT} || unnest({_HREFS}) AS link FROM pages)"


def _links(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", F.explode(ht.hrefs(F.col("html"))).alias("href"))
    return rows.select("page_id", "url", ln.site_root(F.col("url")).alias("base"), ln.resolve(F.col("url"), F.col("href")).alias("link"))


@query("strip_chrome", f"SELECT page_id, {replaced('html', ht.STRIP_CHROME)} AS html FROM pages")
def strip_chrome(spark, sf):
    return table(spark, sf, "pages").select("page_id", ht.strip_chrome(F.col("html")).alias("html"))


@query("html_to_md", f"SELECT page_id, {replaced('html', [*ht.STRIP_CHROME, *ht.MARKDOWN])} AS markdown FROM pages")
def html_to_md(spark, sf):
    return table(spark, sf, "pages").select("page_id", ht.to_markdown(ht.strip_chrome(F.col("html"))).alias("markdown"))


@query("html_text", f"SELECT page_id, {replaced('html', ht.PLAIN)} AS text FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", ht.plain_text(F.col("html")).alias("text"))


_META = '<meta name="author" content="A: B"><meta source="description" content="about"><meta http-equiv="refresh" content="5">'


@query("meta_tags", "SELECT page_id, ['author', 'description', 'http-equiv-refresh'] AS names, ['A: B', 'about', '5'] AS contents FROM pages")
def meta_tags(spark, sf):
    tags = ht.meta_tags(F.concat(F.lit(_META), F.col("html")))
    return table(spark, sf, "pages").select("page_id", F.transform(tags, lambda p: p["key"]).alias("names"), F.transform(tags, lambda p: p["value"]).alias("contents"))


@query(
    "page_metadata",
    "SELECT page_id, 'Site - one' AS source, replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1), ':', ' -') AS title, 'A - B' AS author, url, '2024-01-31' AS access_date, 'CC BY' AS license, 'about' AS description FROM pages",
)
def page_metadata(spark, sf):
    fields = ht.page_metadata(F.concat(F.lit(_META), F.col("html")), F.col("url"), F.lit("Site: one"), F.lit("CC BY"), F.lit("2024-01-31"))
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in fields.items()])


@query("page_name", f"WITH n AS (SELECT page_id, CASE WHEN replace({_PATH}, '/', '') = '' THEN 'index' ELSE replace({_PATH}, '/', '') END AS n FROM pages) SELECT page_id, CASE WHEN starts_with(n, 'wiki') AND length(n) > 4 THEN n[5:] ELSE n END || '.md' AS name FROM n")
def page_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", ln.page_name(F.col("url")).alias("name"))


@query("resolve_links", f"SELECT page_id, link FROM {_LINKS}")
def resolve_links(spark, sf):
    return _links(spark, sf).select("page_id", "link")


_KEEP = "starts_with(link, base) AND NOT contains(link, '#') AND NOT contains(link, '?')"
_TYPES = " OR ".join(f"contains(string_split(lower(link), '.')[-1], {literal(t)})" for t in ln.LINK_FILE_TYPES)
_PAGES = " OR ".join(f"contains(link, {literal(t)})" for t in ln.LINK_PAGE_TYPES)


@query("link_filter_basic", f"SELECT page_id, link FROM {_LINKS} WHERE {_KEEP}")
def link_filter_basic(spark, sf):
    return _links(spark, sf).where(ln.basic_filter(F.col("link"), F.col("base"))).select("page_id", "link")


@query("link_filter", f"SELECT page_id, link FROM {_LINKS} WHERE {_KEEP} AND NOT ({_TYPES}) AND NOT ({_PAGES})")
def link_filter(spark, sf):
    return _links(spark, sf).where(ln.link_filter(F.col("link"), F.col("base"))).select("page_id", "link")


@query("extract_links", f"SELECT DISTINCT page_id, link FROM {_LINKS} WHERE {_KEEP} AND NOT ({_TYPES}) AND NOT ({_PAGES})")
def extract_links(spark, sf):
    return _links(spark, sf).where(ln.link_filter(F.col("link"), F.col("base"))).select("page_id", "link").distinct()


@query("robots_gate", f"SELECT page_id, url FROM pages WHERE {_ROOT} <> '' AND NOT starts_with(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END, '/en/')")
def robots(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    bodies = pages.select(ln.robots_url(F.col("url")).alias("robots_url")).distinct().withColumn("body", F.lit("User-agent: *\nDisallow: /en/\n"))
    return robots_gate(pages, bodies)


def _graph(spark, sf):
    """Every page links to two others, in cycles; the targets are as many as the pages."""
    pages = table(spark, sf, "pages").select("page_id")
    n = max(pages.count(), 1)
    to = F.explode(F.array((F.col("page_id") * 2) % n, (F.col("page_id") * 3 + 1) % n))
    pages = pages.select("page_id", to.alias("to"))
    return pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("to").cast("string")).alias("dst")), spark.createDataFrame([("p5",)], "url string")


_EDGES = "e AS (SELECT 'p' || page_id AS src, 'p' || unnest([(page_id * 2) % n, (page_id * 3 + 1) % n]) AS dst FROM pages, (SELECT count(*) AS n FROM pages))"


@query("crawl_reachable", f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'p5' AS url UNION SELECT dst FROM r JOIN e ON src = url) SELECT url FROM r")
def crawl_reachable(spark, sf):
    return crawl(*_graph(spark, sf)).select("url")


@query("crawl_depth2", f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'p5' AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 2) SELECT url, min(depth) AS depth FROM r GROUP BY url")
def crawl_depth2(spark, sf):
    return crawl(*_graph(spark, sf), max_depth=2)


# ---------------------------------------------------------------- the reader
def _page_html():
    """A page around a document: nested navigation, numbered and nested lists, code, a table, a quote."""
    c, s = F.concat, F.lit
    code = F.replace(F.replace(F.col("text"), s("&"), s("&amp;")), s("<"), s("&lt;"))
    return c(
        s("<html><head><title>"), F.col("source"), s('</title><meta name="author" content="'), F.col("lang"), s('"></head><body><nav><nav><a href="/x">in</a></nav>out</nav><h1>'), F.col("source"),
        s("</h1><ol><li>"), F.col("lang"), s("<li>two<ul><li>deep</ul></ol><pre>\n"), code, s("</pre><table><tr><th>k</th><th>v</th></tr><tr><td>id</td><td>"), F.col("doc_id").cast("string"),
        s('</td></tr></table><blockquote><p>q<p>r</blockquote><a href="/doc/'), F.col("doc_id").cast("string"), s('">more</a></body></html>'),
    )


@query(
    "page_reader",
    r"""WITH d AS (SELECT *, regexp_replace(text, '\n+$', '') AS code, list_max(list_transform(regexp_extract_all(text, '`+'), lambda m: length(m))) AS ticks FROM documents),
f AS (SELECT *, repeat('`', CASE WHEN coalesce(ticks, 0) < 3 THEN 3 ELSE ticks + 1 END) AS fence FROM d)
SELECT doc_id, source AS title, lang AS author, ['/x', '/doc/' || doc_id] AS links,
  '# ' || source || chr(10) || chr(10) || '1. ' || lang || chr(10) || '2. two' || chr(10) || '   * deep' || chr(10) || chr(10)
  || CASE WHEN code = '' THEN '' ELSE fence || chr(10) || code || chr(10) || fence || chr(10) || chr(10) END
  || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| id | ' || doc_id || ' |' || chr(10) || chr(10) || '> q' || chr(10) || '>' || chr(10) || '> r' || chr(10) || chr(10) || '[more](/doc/' || doc_id || ')' AS markdown
FROM f""",
)
def page_reader(spark, sf):
    """Every document in a page of its own, read back by the HTML reader."""
    small_batches(spark)
    rows = table(spark, sf, "documents").select("doc_id", page(_page_html()).alias("p"))
    author = F.filter("p.metas", lambda m: m["key"] == "author")[0]["value"]
    return rows.select("doc_id", "p.title", author.alias("author"), "p.links", "p.markdown")


@query("page_markdown")
def page_markdown(spark, sf):
    """Title, links and Markdown of the given pages, by the HTML reader."""
    small_batches(spark)
    rows = table(spark, sf, "pages").select("page_id", page("html").alias("p"))
    return rows.select("page_id", "p.title", F.size("p.links").alias("n_links"), "p.markdown", "p.text")


@query(
    "resolve_dots",
    f"""WITH b AS (SELECT page_id, {_ROOT} AS root, {_PATH} AS path, regexp_replace(url, '#.*$', '') AS bare, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*:') AS scheme FROM pages),
f AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS folder FROM b)
SELECT page_id, unnest([root || folder || 'b/' || page_id, root || CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]*/$', '') END || 'up', root || '/r/' || page_id || '?q=./y', scheme || '//h.example/', bare || '#f']) AS link FROM f""",
)
def resolve_dots(spark, sf):
    """Links with dot segments, as seen from every page."""
    k = F.col("page_id").cast("string")
    refs = F.array(F.concat(F.lit("./a/../b/"), k), F.lit("../up"), F.concat(F.lit("/r/./x/../"), k, F.lit("?q=./y")), F.lit("//h.example/a/b/../.."), F.lit("#f"))
    rows = table(spark, sf, "pages").select("page_id", "url", F.explode(refs).alias("href"))
    return rows.select("page_id", ln.resolve(F.col("url"), F.col("href")).alias("link"))
