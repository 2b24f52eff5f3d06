import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import numpy as np
import pytest

from corpusloom.operators import vectors as vc
from corpusloom.sources.files import claimed, versions
from corpusloom.sources.page_source import PageSource
from corpusloom.streaming import ingest

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pages(BaseHTTPRequestHandler):
    paths: list[str] = []
    asked: list[str] = []

    def do_GET(self):  # noqa: N802
        url = urlsplit(self.path)
        asked = parse_qs(url.query)
        body = {"/count": str(len(self.paths)), "/robots.txt": "User-agent: *\nDisallow: /no\n", "/index": "\n".join(self.paths[int(asked.get("start", ["0"])[0]) : int(asked.get("end", ["0"])[0])])}.get(url.path)
        if body is None and url.path in self.paths and not url.path.startswith("/broken"):
            self.asked.append(url.path)
            body = f"<h1>{url.path}</h1>é"
        self.send_response(404 if body is None else 200)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write((body or "").encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    Pages.paths, Pages.asked = [f"/p{k}" for k in range(5)], []
    http = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_address[1]}/"
    http.shutdown()


def test_pages_of_a_site_in_batch(spark, server):
    spark.dataSource.register(PageSource)
    Pages.paths += ["/no/1", "/broken"]
    rows = spark.read.format("site_pages").option("sites", f"{server},http://127.0.0.1:1/").option("delay", "0").option("request", "2").load()
    for _ in range(2):
        got = sorted((r.position, r.url.rsplit("/", 1)[1], r.html, (r.error or "")[:9]) for r in rows.collect())
        assert got == [*[(k, f"p{k}", f"<h1>/p{k}</h1>é", "") for k in range(5)], (6, "broken", None, "HTTPError")]
    with pytest.raises(Exception, match="names no site"):
        spark.read.format("site_pages").load().collect()


def test_offsets_go_on(spark, server, tmp_path):
    spark.dataSource.register(PageSource)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        rows = spark.readStream.format("site_pages").option("sites", server).option("delay", "0").option("request", "3").load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.position for r in spark.read.parquet(out).collect())

    assert run() == [0, 1, 2, 3, 4]
    Pages.paths += ["/p5", "/p6"]
    assert run() == list(range(7))
    assert run() == list(range(7))
    assert sorted(Pages.asked) == sorted(Pages.paths)  # each page was fetched once


def test_conversations_as_state(spark, sf, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        rows = spark.read.parquet(f"{sf}/conversations.parquet")
        half = tmp_path / "turns"
        rows.where("turn < 2").coalesce(1).write.parquet(str(half / "a"))
        go = lambda: ingest.replayed(ingest.conversation_memory(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(half)), most=3, turn="turn"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        go()
        rows.where("turn >= 2").coalesce(1).write.parquet(str(half / "b"))
        go()
        last = {}
        for r in spark.read.parquet(str(tmp_path / "out")).collect():
            if r.n_turns > last.get(r.conv_id, (0,))[0]:
                last[r.conv_id] = (r.n_turns, r.recent)
        want = {}
        for r in rows.orderBy("conv_id", "turn").collect():
            n, texts = want.get(r.conv_id, (0, []))
            want[r.conv_id] = (n + 1, [*texts, r.text][-3:])
        assert last == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _files(spark, *names):
    rows = [(f"{n}.md", 200, f"# Title {n}\n\nText of {n} that is long enough to be kept.\n", "src", f"/docs/{n}.md") for n in names]
    return spark.createDataFrame(rows, "name string, size long, content string, source string, path string")


def _refusing(word):
    def make():
        def run(texts):
            if any(word in t for t in texts):
                raise ValueError("no")
            return np.ones((len(texts), 4), np.float32)

        return run

    return vc.careful_embedder(make, wait=0)


def test_a_retry_and_a_batch_at_the_same_time(spark, tmp_path):
    root = str(tmp_path)
    assert ingest.embed_batch(_files(spark, "a"), 0, root, "headers", embed=_refusing("of a")) == {"tried": 1, "failed": 1}
    threads, found = [], {}
    for name, go in (("retry", lambda: ingest.retry_dead_letters(spark, root, 0, embed=_refusing("of a"))), ("files", lambda: ingest.embed_batch(_files(spark, "b", "c"), 1, root, "headers", embed=_refusing("of b")))):
        threads.append(threading.Thread(target=lambda name=name, go=go: found.update({name: go()})))
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert found == {"retry": {"tried": 1, "failed": 1}, "files": {"tried": 2, "failed": 1}}
    dead = sorted((r.path, r.attempt, r.batch) for r in spark.read.parquet(f"{root}/dead_letter").collect())
    assert dead == [("/docs/a.md", 1, "files-0"), ("/docs/a.md", 2, "retry-0"), ("/docs/b.md", 1, "files-1")]
    assert len({v for v, _ in versions(spark, f"{root}/vectors")}) == 3
    assert ingest.retry_dead_letters(spark, root, 1) == {"tried": 2, "failed": 0}
    assert sorted(r.path for r in ingest.collection(spark, root).collect()) == ["/docs/a.md", "/docs/b.md", "/docs/c.md"]


def test_numbers_are_claimed_once(spark, tmp_path):
    path = str(tmp_path / "v")
    got = {}
    threads = [threading.Thread(target=lambda k=k: got.update({k: claimed(spark, path, f"b-{k}")})) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got.values()) == list(range(8))
    assert claimed(spark, path, "b-3") == got[3] and claimed(spark, path, "b-30") == 8
