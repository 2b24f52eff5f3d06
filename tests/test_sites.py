from corpusloom import cli
from corpusloom.operators import site
from corpusloom.operators import vectors as vc
from corpusloom.streaming import ingest

PAGES = {
    "http://a.x/": '<html><head><title>Home</title></head><body><nav><a href="/one">1</a><a href="/no/two">2</a><a href="/pic.png">p</a></nav><h1>Hi</h1></body></html>',
    "http://a.x/one": '<html><body><a href="/">home</a><a href="/three">3</a><p>one</p></body></html>',
    "http://a.x/three": "<html><body><p>three</p></body></html>",
}


def test_crawl_of_a_site(spark, tmp_path):
    sites = spark.createDataFrame([("My Site", "http://a.x/", "CC BY")], "source string, url string, license string")
    robots = spark.createDataFrame([("http://a.x/robots.txt", "User-agent: *\nDisallow: /no")], "robots_url string, body string")
    go = lambda root, **o: sorted((r.url, r.depth) for r in site.crawl_sites(sites, robots, str(root), "2024-01-31", get=lambda u, t: PAGES[u], delay=0, **o).collect())
    assert go(tmp_path / "a") == [("http://a.x/", 0), ("http://a.x/one", 1), ("http://a.x/three", 2)]
    assert go(tmp_path / "b", max_depth=1) == [("http://a.x/", 0), ("http://a.x/one", 1)]
    rows = {r.path: r.content for r in spark.read.parquet(str(tmp_path / "a" / "documents")).collect()}
    assert rows["My_Site/index.md"].startswith("---\nsource: My Site\ntitle: Home\nauthor: \nurl: http://a.x/\naccess_date: 2024-01-31\nlicense: CC BY\n") and rows["My_Site/index.md"].endswith("# Hi")
    go(tmp_path / "a")  # pages that are there are not written twice
    assert spark.read.parquet(str(tmp_path / "a" / "documents")).count() == 3


def test_a_crawl_that_failed_between_levels_goes_on(spark, tmp_path):
    from corpusloom.sources.files import read_pages

    sites = spark.createDataFrame([("My Site", "http://a.x/", "CC BY")], "source string, url string, license string")
    robots = spark.createDataFrame([("http://a.x/robots.txt", "User-agent: *")], "robots_url string, body string")
    log, root = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()

    def get(url, _):
        (log / url.replace("/", "_")).open("a").write("x")
        return PAGES[url]

    go = lambda **o: sorted((r.url, r.depth) for r in site.crawl_sites(sites, robots, root, "2024-01-31", get=get, delay=0, run="r1", **o).collect())
    assert go(max_depth=0) == [("http://a.x/", 0)]
    # The next level was fetched, but the run died before its documents were written.
    assert go(max_depth=1) == [("http://a.x/", 0), ("http://a.x/no/two", 1), ("http://a.x/one", 1)]
    (tmp_path / "out" / "documents" / "level=r1-1" / "_SUCCESS").unlink()
    assert {r.path for r in read_pages(spark, f"{root}/documents").collect()} == {"My_Site/index.md"}
    assert len(go()) == 4
    paths = [r.path for r in read_pages(spark, f"{root}/documents").collect()]
    assert sorted(paths) == ["My_Site/index.md", "My_Site/one.md", "My_Site/three.md"]
    assert all(f.read_text() == "x" for f in log.iterdir())  # no page was fetched twice


def test_pages_with_one_name(spark, tmp_path):
    from corpusloom.sources.files import read_pages, write_new_pages

    rows = spark.createDataFrame([("s/a.md", "http://x/b", "2"), ("s/a.md", "http://x/a", "1"), ("s/c.md", "http://x/c", "3")], "path string, url string, content string")
    for _ in range(2):
        assert write_new_pages(rows, str(tmp_path / "d"), "0").count() == 3
    write_new_pages(rows.where("path = 's/a.md'"), str(tmp_path / "d"), "1")
    assert sorted((r.path, r.content, str(r.level)) for r in read_pages(spark, str(tmp_path / "d")).collect()) == [("s/a.md", "1", "0"), ("s/c.md", "3", "0")]


def test_failures_are_retried(spark, tmp_path):
    root = str(tmp_path / "out")
    files = spark.createDataFrame([("a.md", 9, "# A\ngood text", "s", "s/a.md"), ("b.md", 9, "# B\nbad text", "s", "s/b.md")], "name string, size long, content string, source string, path string")

    def picky():
        def run(texts):
            if any("bad" in t for t in texts):
                raise OSError("no answer")
            return vc.hashed(texts)

        return run

    ingest.embed_batch(files, 0, root, "headers", embed=vc.careful_embedder(picky, wait=0))
    assert [r.section_path for r in ingest.collection(spark, root).collect()] == ["A"]
    dead = spark.read.parquet(f"{root}/dead_letter").collect()
    assert [(r.section_path, r.attempt, "no answer" in r.error) for r in dead] == [("B", 1, True)]
    ingest.retry_dead_letters(spark, root, 1, embed=vc.careful_embedder(picky, wait=0))
    assert spark.read.parquet(f"{root}/dead_letter").where("attempt = 2").count() == 1
    ingest.retry_dead_letters(spark, root, 2)
    assert {r.section_path for r in ingest.collection(spark, root).collect()} == {"A", "B"}


def test_command_line():
    args = cli.parser().parse_args(["chunk", "in", "out", "--strategy", "headers"])
    assert (args.strategy, args.size) == ("headers", 1000)
