import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import cite, html, links
from corpusloom.operators import chunk as ch
from corpusloom.operators import incremental as inc
from corpusloom.operators import keywords as kw
from corpusloom.operators import vectors as vc
from corpusloom.operators.crawl import crawl
from corpusloom.sources import files, web
from corpusloom.streaming import ingest


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column.alias("x")).first().x


def test_split_size():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("w" * rng.randrange(1, 12) for _ in range(rng.randrange(1, 200))) for _ in range(20)) + "x" * 2500
    chunks = ch.split_size(text)
    assert all(0 < len(c) <= ch.SIZE for c in chunks)
    assert "".join(text.split())[:50] == "".join(chunks[0].split())[:50] and chunks[-1][-1] == "x"
    at = 0
    for c in chunks:  # each chunk is in the text, beginning at most where the one before ended
        found = text.find(c, max(0, at - ch.OVERLAP - 5))
        assert 0 <= found <= at + 3
        at = found + len(c)
    assert ch.split_size("") == [] and ch.split_size("  \n ") == []


def test_headers():
    text = "# A\nx\n```\n# code\n```\n### C\ny\n## B\nz"
    assert [(h, c.split("\n")[0]) for h, c in ch.split_headers(text)] == [(["A", None, None, None], "# A"), (["A", None, "C", None], "### C"), (["A", "B", None, None], "## B")]


def test_pack(spark):
    units = F.split("t", ",")
    assert value(spark, ch.pack(units, 5), t="aaa,bb,c,dddddddd,e") == ["aaa bb", "c", "dddddddd", "e"]
    assert value(spark, ch.pack(units, 5), t="dddddddd") == ["dddddddd"]  # no empty first chunk


def test_merge_lists(spark):
    rows = [(1, k, t) for k, t in enumerate(["x", "- a", "* b", "1. c", "y", "- d"])] + [(2, 0, "- z")]
    got = ch.merge_lists(spark.createDataFrame(rows, "d int, i int, t string"), "d", "i", "t")
    assert sorted(map(tuple, got.collect())) == [(1, 0, "x"), (1, 1, "- a\n* b\n1. c"), (1, 4, "y"), (1, 5, "- d"), (2, 0, "- z")]


def test_chunk_documents(spark):
    df = spark.createDataFrame([("p.md", "---\ntitle: t\n---\n# A\nbody one. Body two.\n## B\nmore"), ("q.md", None)], "path string, text string")
    for strategy in ch.Strategy:
        rows = ch.chunk_documents(df, strategy=strategy).orderBy("path", "chunk_index").collect()
        assert {r.path for r in rows} == {"p.md"} and [r.chunk_index for r in rows] == list(range(len(rows)))
        assert rows[0].frontmatter == "title: t"
        assert [r.section_path for r in rows] == (["A", "A > B"] if strategy is ch.Strategy.HEADERS else [None])
    ids = lambda: sorted(r.chunk_id for r in ch.chunk_documents(df, strategy="size").collect())
    assert ids() == ids()


def test_keywords(spark):
    text = "solar panel output and the solar panel cost with wind turbine output"
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id int, t string")
    top = kw.top_keywords(df, "id", "t").orderBy("rank").collect()
    assert [r.keyword for r in top[:2]] == ["output", "panel"] and {r.id for r in top} == {1}
    plain, diverse, distant = (df.orderBy("id").select(kw.extract_keywords(F.col("t"), **o).alias("k")).collect() for o in ({"maxsum": False}, {"mmr": True}, {}))
    assert plain[0].k == [r.keyword for r in top]
    assert len(set(diverse[0].k)) == len(set(distant[0].k)) == 5 and diverse[1].k == [] and distant[2].k == []


def test_html(spark):
    page = '<html><head><title>T: x</title><meta name="author" content="Me"></head><body><nav><a href="/n">n</a></nav><script>"</p>"</script><h2>Head</h2><p>a <b>bold</b> &amp; <a href="/l">link</a></p><ul><li>i</li></ul></body></html>'
    stripped = html.strip_chrome(F.col("h"))
    assert value(spark, html.to_markdown(stripped), h=page) == "## Head\n\na **bold** & [link](/l)\n\n* i"
    assert value(spark, html.plain_text(F.col("h")), h="<div>a<a href=\"x\">gone</a>b</div>") == "a\nb"
    meta = html.page_metadata(F.col("h"), F.lit("http://a/b"), F.lit("S"), F.lit(None), F.lit("2024-01-01"))
    assert value(spark, F.struct(*[c.alias(n) for n, c in meta.items()]), h=page).asDict() == {"source": "S", "title": "T - x", "author": "Me", "url": "http://a/b", "access_date": "2024-01-01", "license": "", "description": ""}


def test_links(spark):
    from urllib.parse import urljoin

    for base in ["http://a.b/c/d.html?x#y", "https://a.b"]:
        for href in ["/r", "e.html", "#f", "?q=1", "//h/i", "http://z/", "mailto:me", ""]:
            assert value(spark, links.resolve(F.col("b"), F.col("h")), b=base, h=href) == urljoin(base, href)
    keep = lambda u, **o: value(spark, links.link_filter(F.col("u"), F.lit("http://a/"), **o), u=u)
    assert keep("http://a/b") and not keep("http://a/b.PDF") and not keep("http://a/b#c") and not keep("http://c/") and not keep("http://a/tag/b")
    assert not keep("http://a/b.ecosystem") and keep("http://a/b.ecosystem", suffix_only=True)
    assert value(spark, links.page_name(F.col("u")), u="http://a/") == "index.md"
    assert value(spark, links.page_name(F.col("u")), u="http://a/wiki/Page/b?c") == "Pageb.md"


def test_crawl_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("b", "b")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), (None,)], "url string")
    assert sorted(map(tuple, crawl(edges, seeds).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert crawl(edges, seeds, max_depth=1).count() == 2


def test_robots_and_languages(spark):
    pages = spark.createDataFrame([("http://a/x/y",), ("http://a/z",), ("http://b/z",)], "url string")
    robots = spark.createDataFrame([("http://a/robots.txt", "User-agent: *\nDisallow: /x")], "robots_url string, body string")
    assert [r.url for r in web.robots_gate(pages, robots).collect()] == ["http://a/z"]
    detect = web.language_detector({"en": "the cat and the dog of the house with this", "de": "der hund und die katze in dem haus mit diesem"})
    got = spark.createDataFrame([("the mouse of the house",), ("die maus und der hund",), ("123",)], "t string").select(detect("t").alias("l"))
    assert [r.l for r in got.collect()] == ["en", "de", None]
    got = web.fetch(pages, get=lambda u, t: "page" if "z" in u else 1 / 0, delay=0).collect()
    assert sorted((r.url, r.html) for r in got)[0] == ("http://a/x/y", None) and sum(r.html == "page" for r in got) == 2


def test_statuses(spark):
    columns = "cache_file string, mtime double, size long, content_hash string, jsonl_mtime double"
    now = spark.createDataFrame([("new", 1.0, 1, "h", 1.0), ("same", 1.0, 1, "h", 1.0), ("touched", 2.0, 1, "h", 1.0), ("changed", 2.0, 1, "i", 1.0), ("legacy", 1.0, 1, "h", 2.0), ("gone", None, None, None, 1.0)], columns)
    old = spark.createDataFrame([("same", 1.0, 1, "h", 1.0), ("touched", 1.0, 1, "h", 1.0), ("changed", 1.0, 1, "h", 1.0), ("legacy", None, None, None, 1.0), ("gone", 1.0, 1, "h", 1.0)], columns)
    got = {r.cache_file: r.status for r in inc.cache_status(now, old, "cache_file").collect()}
    assert got == {"new": "new", "same": "unchanged", "touched": "touched", "changed": "changed", "legacy": "changed", "gone": "changed"}
    assert {r.cache_file: r.status for r in inc.changed_files(now, old).collect()} == {"new": "new", "changed": "modified", "legacy": "modified", "gone": "modified"}


def test_upsert_batches_and_retries(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 4)], "chunk_id string, v int")
    first = inc.upsert(old, new)
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 3), ("c", 4)] == sorted(map(tuple, inc.upsert(first, new).collect()))
    numbered = inc.assign_batches(spark.range(250).withColumnRenamed("id", "i"), "i", 100).collect()
    assert all(r.batch_no == r.i // 100 + 1 for r in numbered)
    dead = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "chunk_id string, attempt int")
    assert [(r.chunk_id, r.attempt) for r in inc.retryable(dead, old).collect()] == [("a", 3)]


def test_topk_metrics(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(100, rng.normal(size=8).tolist())]
    rows.append((101, rows[-1][1]))  # a tie
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id < 3 or vec_id = 100").withColumnRenamed("vec_id", "query_id")
    for metric in vc.METRICS:
        got = {(r.query_id, r["rank"]): r.vec_id for r in vc.topk_batch(df, asked, 3, metric=metric, query_bytes=100).collect()}
        for q in (0, 1, 2, 100):
            one = [r.vec_id for r in vc.topk(df, dict(rows)[q], 3, metric=metric).collect()]
            assert [got[q, k] for k in (1, 2, 3)] == one


def test_citation_of_odd_metadata(spark):
    c = cite.citation(F.lit(1), F.col("s"), F.col("t"), F.lit(None).cast("string"), F.col("u"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    x = value(spark, c, s="None", t="", u="")
    assert x.citation_text == "[1] Unknown: Unknown, URL:" and x.hyperlink_citation == "[1] [Unknown: Unknown]()"


def test_chunk_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "d.jsonl").write_text('{"page_content": "Valid", "metadata": {"source": "s", "k": ["x"]}}\n{"page_content": "   ", "metadata": {}}\n{"page_content": "", "metadata": {}}\n{"page_content": "Another"}\n')
    rows = files.read_chunks(spark, str(tmp_path)).collect()
    assert sorted((r.page_content, r.file, dict(r.metadata)) for r in rows) == [("Another", "a/d.jsonl", {}), ("Valid", "a/d.jsonl", {"source": "s"})]
    assert files.read_chunks(spark, str(tmp_path / "none")).count() == 0


def test_stream_of_a_directory(spark, tmp_path):
    folder, root = tmp_path / "in" / "site", str(tmp_path / "out")
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("# A\nfirst text\n")
    ingest.stream_directory(spark, str(tmp_path / "in"), root, "headers").awaitTermination()
    assert ingest.collection(spark, root).count() == 1
    (folder / "b.md").write_text("# B\nsecond text\n")
    ingest.stream_directory(spark, str(tmp_path / "in"), root, "headers").awaitTermination()
    rows = ingest.collection(spark, root).collect()
    assert {r.section_path for r in rows} == {"A", "B"} and all(len(r.embedding) == vc.DIMENSIONS for r in rows)


def test_chunk_files_come_back(spark, tmp_path):
    """A large source is several files; what is blank stays out, and only the files asked for are read."""
    rows = [("s1" if k % 3 else "s 2", k, None if k == 4 else " \n" if k == 5 else f'line "{k}"\nnext') for k in range(40)]
    chunks = spark.createDataFrame(rows, "cache_key string, chunk_index int, page_content string").withColumn("metadata", F.struct(F.col("chunk_index").alias("n")))
    folder = str(tmp_path / "chunks")
    files.write_chunks(chunks, folder)
    back = files.read_chunks(spark, folder)
    assert sorted((int(r.metadata["n"]), r.page_content) for r in back.collect()) == [(k, t) for _, k, t in rows if k not in (4, 5)]
    first = back.where("file LIKE '%=s1/%'").select("file")
    assert {int(r.metadata["n"]) % 3 for r in files.read_chunks(spark, folder, first).collect()} == {1, 2}
