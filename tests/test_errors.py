import pytest

from corpusloom import cli
from corpusloom.functions.yaml_front import NODES, parsed, typed, with_typed_frontmatter
from corpusloom.operators import chunk as ch
from corpusloom.operators import keywords as kw
from corpusloom.plans import corpus_queries  # noqa: F401  registers the queries
from corpusloom.plans.registry import QUERIES


def poisoned(text):
    if "poison" in text:
        raise RuntimeError("cannot cut")
    return ch.cut(text, ch.Strategy.HEADERS, 40, 0)


def test_one_poisoned_file_is_one_row(spark):
    files = spark.createDataFrame([("a", "# A\nfine text here"), ("b", "poison"), ("c", None), ("d", "more fine text")], "path string, text string")
    rows = ch.chunk_documents(files, cutter=poisoned, errors=True).orderBy("path").collect()
    assert [(r.path, r.chunk_index, r.page_content, r.error) for r in rows] == [("a", 0, "# A\nfine text here", None), ("b", None, None, "RuntimeError: cannot cut"), ("d", 0, "more fine text", None)]
    assert rows[1].chunk_id is None and rows[1].keywords == [] and rows[0].keywords
    with pytest.raises(Exception, match="cannot cut"):
        ch.chunk_documents(files, cutter=poisoned).collect()
    assert "error" not in ch.chunk_documents(files).columns


def test_keywords_of_a_batch_with_a_bad_text(spark, monkeypatch):
    import pandas as pd

    def pick(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return [[t[:4]] for t in texts]

    assert kw._each(pd.Series(["good text 1", "bad text 22", None, "short", "good text 2"]), pick).tolist() == [["good"], [], [], [], ["good"]]


def failing(whole, bad):
    """``whole``, a ranking of one or many texts, but those with ``bad`` in them fail."""

    def run(texts, *more):
        if any(bad in t for t in ([texts] if isinstance(texts, str) else texts)):
            raise ValueError("not ranked")
        return whole(texts, *more)

    return run


@pytest.mark.parametrize("name", ["chunk_pipeline", "chunk_pipeline_size"])
def test_chunk_pipeline_ends_where_keywords_fail(spark, sf, monkeypatch, name):
    bad = QUERIES[name](spark, sf).where("length(page_content) > 50").first().page_content
    monkeypatch.setattr(kw, "max_sums", failing(kw.max_sums, bad))
    with pytest.raises(Exception, match="keywords of .* failed.*ValueError: not ranked"):
        QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize(("name", "ranking"), [("keywords_mmr", "marginal"), ("keywords_maxsum", "max_sums"), ("keywords_top", "frequent")])
def test_keyword_queries_end_where_a_text_fails(spark, sf, monkeypatch, name, ranking):
    bad = spark.read.parquet(f"{sf}/documents.parquet").where("length(trim(text)) > 50").orderBy("doc_id").first().text
    monkeypatch.setattr(kw, ranking, failing(getattr(kw, ranking), bad))
    with pytest.raises(Exception, match="keywords of .* failed.*ValueError: not ranked"):
        QUERIES[name](spark, sf).collect()


def test_chunks_whose_keywords_fail_have_their_error(spark, monkeypatch):
    monkeypatch.setattr(kw, "max_sums", failing(kw.max_sums, "unlucky"))
    files = spark.createDataFrame([("a", "# A\nfine text here\n# B\nunlucky text here\n# C\nthe"), ("b", "poison")], "path string, text string")
    rows = ch.chunk_documents(files, cutter=poisoned, errors=True).orderBy("path", "chunk_index").collect()
    assert [(r.path, r.chunk_index, r.keywords is None, r.error) for r in rows] == [("a", 0, False, None), ("a", 1, True, "keywords: ValueError: not ranked"), ("a", 2, False, None), ("b", None, False, "RuntimeError: cannot cut")]
    assert rows[0].keywords and rows[2].keywords == [] and all(r.chunk_id for r in rows[:3]) and rows[3].chunk_id is None and "unlucky" in rows[1].page_content
    plan = ch.chunk_documents(files, errors=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the cuts and the keywords, each once
    with pytest.raises(Exception, match="not ranked"):
        ch.chunk_documents(files.where("path = 'a'")).collect()


def test_yaml_values_and_errors(spark):
    block = "date: 2024-02-03\nat: 2024-02-03 04:05:06\nn: 7\nx: 1.5\nyes: true\nlist: [1, [a, b]]\nmap: {a: {b: é}}\nnone:\n3: three\nbig: 123456789012345678901234567890\ninf: .inf\ntitle: first\ntitle: last"
    cases = [(1, f"---\n{block}\n---\nbody"), (2, "---\na: [1\n---\nbody"), (3, "no block"), (4, None), (5, "---\n- a\n- b\n---\nbody"), (6, "---\nd: 2024-13-45\n---\nbody"), (7, "---\n# only a comment\n---\nbody")]
    got = {r.k: r for r in with_typed_frontmatter(spark.createDataFrame(cases, "k int, text string")).selectExpr("k", "to_json(front.value) AS json", "front.error AS error", "front.body AS body").collect()}
    assert [k for k, r in got.items() if r.error] == [2, 5, 6] and "list, not a map" in got[5].error and got[2].json is None
    assert got[3].json is None and got[3].error is None and got[7].json == "{}" and got[1].body == "body"
    row = with_typed_frontmatter(spark.createDataFrame(cases[:1], "k int, text string"))
    v = row["front.value"]
    one = row.select(typed(v, "$.date", "date").alias("date"), typed(v, "$.at", "timestamp_ntz").cast("string").alias("at"), typed(v, "$.list[1][0]", "string").alias("a"), typed(v, "$.map.a", "map<string,string>").alias("m"), typed(v, "$.big", "decimal(38,0)").alias("big"), typed(v, "$.title", "string").alias("title"), typed(v, "$.list", "date").alias("no"), typed(v, "$.inf", "string").alias("inf"), typed(v, "$.none", "string").alias("none")).first()
    assert (str(one.date), one["at"], one.a, one.m, int(one.big), one.title, one.no, one.inf, one.none) == ("2024-02-03", "2024-02-03 04:05:06", "a", {"b": "é"}, 123456789012345678901234567890, "last", None, "inf", None)


def test_aliases_do_not_unfold_without_end():
    laughs = "a0: &a0 [x, x, x, x, x, x, x, x, x, x]\n" + "\n".join(f"a{k}: &a{k} [{', '.join([f'*a{k - 1}'] * 10)}]" for k in range(1, 9))
    assert str(NODES) in parsed(laughs)[1]
    assert parsed("a: " + "[" * 5000 + "]" * 5000)[1]


def test_commands_tell_their_counts(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    folder = tmp_path / "md" / "my_site"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("---\ntitle: A\n---\n\n# A\n\nsome text of a page\n")
    (folder / "b.md").write_text("text of another page")
    run = lambda *args: (cli.main([*args]), capsys.readouterr().out.strip())[1]
    source, out = str(tmp_path / "md"), str(tmp_path / "out")
    assert run("chunk", source, f"{out}/chunks", "--strategy", "headers", "--no-keywords") == "{'chunks': 2, 'failed': 0}"
    assert run("chunk", source, f"{out}/store", "--store") == "{'new': 2}" and run("chunk", source, f"{out}/store", "--store") == "{'unchanged': 2}"
    assert run("frontmatter", source, f"{out}/front", "--add", "license=CC0") == "{'files': 2, 'modified': 2}"
    assert "license: CC0" in spark.read.parquet(f"{out}/front").where("name = 'a.md'").first().updated
    assert run("tables", source, f"{out}/tables") == "{'files': 2, 'modified': 0}"
    assert run("ingest", source, f"{out}/collection", "--strategy", "headers") == "{'tried': 2, 'failed': 0}"
    assert run("retry", f"{out}/collection", "1") == "{'tried': 0, 'failed': 0}"
