"""Sites crawled into Markdown pages with frontmatter.

Levels of links are fetched one after another: a level's pages pass the robots
gate, are fetched host by host, and give the next level by their links, less
what has been visited. Pages already written are kept, but their links followed.

Of a run, ``crawl-RUN/level=N`` has the pages fetched at depth N, and
``documents/level=RUN-N`` the documents new with them. A level counts once it was
written to its end, so a run that is called again goes on where it ended: levels
that are there are not fetched again, and no document is written twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import frontmatter as fm
from corpusloom.functions import html, links
from corpusloom.functions.html_reader import page
from corpusloom.session import small_batches
from corpusloom.sources.files import exists, read_pages, write_new_pages
from corpusloom.sources.web import DELAY, TIMEOUT, _get, fetch, robots_gate


def page_documents(pages: DataFrame, day: str, languages: tuple[str, ...] = (), detect=None) -> DataFrame:
    """source, path, url and content of fetched pages (url, html, source, license); ``detect`` and ``languages`` leave out others."""
    small_batches(pages.sparkSession)
    read = pages.where("html IS NOT NULL").withColumn("page", page("html"))
    value = lambda key: F.coalesce(F.try_element_at(F.filter("page.metas", lambda m: m["key"] == key), F.lit(-1))["value"], F.lit(""))
    fields = html.metadata_fields(F.col("page.title"), value("author"), value("description"), F.col("url"), F.col("source"), F.col("license"), F.lit(day))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
    if languages:
        read = read.where(detect(F.col("page.text")).isin(*languages))
    path = F.concat(links.source_folder(F.col("source")), F.lit("/"), links.page_name(F.col("url")))
    return read.select("source", path.alias("path"), "url", fm.document(entries, F.concat(F.lit("\n\n"), F.col("page.markdown"))).alias("content"))


def page_links(pages: DataFrame) -> DataFrame:
    """source, license, root and url of the links a crawl follows; of the whole page, navigation included."""
    small_batches(pages.sparkSession)
    rows = pages.where("html IS NOT NULL").select("source", "license", "root", "url", F.explode(page("html")["links"]).alias("href"))
    found = rows.select("source", "license", "root", links.resolve(F.col("url"), F.col("href")).alias("url"))
    return found.where(links.link_filter(F.col("url"), F.col("root"))).distinct()


def crawl_sites(sites: DataFrame, robots: DataFrame, root: str, day: str, max_depth: int | None = None, get=_get, delay: float = DELAY, timeout: float = TIMEOUT, run: str | None = None) -> DataFrame:
    """Crawl ``sites`` (source, url, license) and write new pages to ``root``/documents; all pages reached (source, url, depth).

    ``robots``: robots_url and body of each site. ``run`` names the crawl, so
    that one that failed can be called again; by default it is a new one.
    """
    spark, root = sites.sparkSession, root.rstrip("/")
    run = run or uuid.uuid4().hex
    folder = f"{root}/crawl-{run}"
    level, depth = sites.select("source", "license", links.site_root(F.col("url")).alias("root"), "url").dropDuplicates(["url"]), 0
    while True:
        here = f"{folder}/level={depth}"
        if not exists(spark, f"{here}/_SUCCESS"):
            allowed = robots_gate(level, robots)
            fetch(allowed.select("url"), get=get, delay=delay, timeout=timeout).join(allowed, "url").write.mode("overwrite").parquet(here)
        pages = spark.read.parquet(here)
        write_new_pages(page_documents(pages, day), f"{root}/documents", f"{run}-{depth}")
        visited = read_pages(spark, folder).where(F.col("level").cast("int") <= depth)  # a run that goes on may have later ones
        if depth == max_depth:
            break
        level = page_links(pages).dropDuplicates(["url"]).join(visited.select("url"), "url", "left_anti")
        if level.isEmpty():
            break
        depth += 1
    return visited.select("source", "url", F.col("level").cast("int").alias("depth"))
