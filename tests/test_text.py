import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import frontmatter as fm
from corpusloom.functions import repair
from corpusloom.functions import text as tx
from corpusloom.operators.clean import clean_documents, clean_stats, process, update_frontmatter


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column.alias("x")).first()
    return row.x


def once(spark, text, **options):
    return tx.dedupe_lines(spark.createDataFrame([(text,)], "t string"), "t", "o", **options).first().o


def test_strip_knows_unicode(spark):
    for text in ["  a b ", " x ", "\x1c\x1fa\x1d", "\n\n", "", "a\x85"]:
        assert value(spark, tx.strip(F.col("t")), t=text) == text.strip()


def test_lines(spark):
    for text in ["a\r\nb\rc", "a\n\nb\n", "", " a b\x0bc\x0cd\x85e\x1cf", "\n"]:
        assert value(spark, tx.lines(F.col("t")), t=text) == text.splitlines()


def test_boilerplate(spark):
    cut = tx.remove_boilerplate(F.col("t"))
    assert value(spark, cut, t=" keep \nRetrieved from x\nNavigation menu") == "keep"
    assert value(spark, cut, t=" as it is ") == " as it is "
    assert value(spark, cut, t="a ###### WHO WE ARE b") == "a"


def test_dedupe_lines(spark):
    assert once(spark, "a\n b\n\nb \n\na\nc\n") == "a\n b\n\nc"
    assert once(spark, "a\n\nb\n\nb", keep_blank=True) == "a\n\nb\n"
    assert once(spark, "") == ""


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", " a", "b ", "", "  ", "c"]), max_size=12))
def test_dedupe_twice_is_dedupe_once(spark, rows):
    first = once(spark, "\n".join(rows))
    assert once(spark, first).rstrip("\n") == first.rstrip("\n")


def test_headings(spark):
    loose, strict = (tx.standardize_headings(F.col("t"), strict=s) for s in (False, True))
    assert value(spark, loose, t="A\n===\nB\n---\nc") == "# A\n## B\nc"
    assert value(spark, loose, t="Intro:\n- item") == "## Intro: item"
    assert value(spark, strict, t="Intro:\n- item\nB\n---") == "Intro:\n- item\n## B"


@pytest.mark.parametrize(
    ("name", "size", "reason"),
    [("a.md", 0, "empty file"), ("File:x.png", 1, "disallowed page type: File:"), ("file:x.md", 1, None), ("x.tar.gz", 1, "disallowed file type: .tar"), ("tagetes.md", 1, "tag file"), (".initial.md", 1, "disallowed file type: .ini"), ("ok.md", 5, None)],
)
def test_reject_reason(spark, name, size, reason):
    assert value(spark, tx.reject_reason(F.col("n"), F.col("s")), n=name, s=size) == reason


def test_names(spark):
    assert value(spark, tx.wiki_rename(F.col("t")), t="wikiPage.md") == "Page.md"
    assert value(spark, tx.cache_key(F.col("t")), t="/data/src/a.b.md") == "src/a.b"
    assert value(spark, tx.url_to_filename(F.col("t")), t="https://a.b/c?d=é") == "a.b_c_d_é.md"
    assert value(spark, tx.dedupe_description(F.col("t")), t="one two three.one two three.") == "one two three."
    assert value(spark, tx.dedupe_description(F.col("t")), t="one two") == "one two"


def test_frontmatter(spark):
    text = "---\ntitle: \"A: b\"\n## no: x\nurl: https -//a\ntitle: 'C'\nz: 1\nnone\n---\nbody --- more"
    x = value(spark, fm.parse(F.col("t")), t=text)
    assert [(e.key, e.value) for e in x.entries] == [("title", "C"), ("url", "https://a"), ("z", "1")]
    assert x.body == "\nbody --- more"
    assert value(spark, fm.build(fm.parse(F.col("t"))["entries"]), t=text) == "title: C\nurl: https://a\nz: 1"
    assert value(spark, fm.parse(F.col("t")), t="no block").body == "no block"
    assert value(spark, fm.extract(F.col("t")), t="---\na: é\n---\nrest").block == "a: é"


def test_a_text_is_split_once(spark):
    rows = spark.createDataFrame([("---\na: 1\n---\nb",)], "t string").select(fm.build(fm.parse(F.col("t"))["entries"]).alias("front"))
    assert rows.first().front == "a: 1"
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(", ---, 3") == 1


def test_parse_undoes_build(spark):
    text = "---\nsource: a\ntitle: b\ncustom: c\n---\nbody"
    again = fm.document(fm.parse(F.col("t"))["entries"], fm.parse(F.col("t"))["body"])
    assert value(spark, again, t=text) == text


BROKEN = """---
source: Somewhere
title: Toilets, Bathrooms and Ultra
---
Designs
author: ''
url: https://x.example/y/
license: CC BY 3.0
## description: ''

text"""


def test_repaired_delimiter():
    want = "---\nsource: Somewhere\ntitle: Toilets, Bathrooms and Ultra Designs\nauthor: ''\nurl: https://x.example/y/\nlicense: CC BY 3.0\ndescription: ''\n\n---\ntext"
    assert fm.repaired(BROKEN) == want
    assert fm.repaired("---\na: b\n---\nauthor: c\ntext") == "---\na: b\nauthor: c\n---\ntext"  # a key after the delimiter is kept
    for same in ["no", "---", "---\ntitle: x\n---\nbody", "---\n" + "k: v\n" * 6 + "---\nauthor: x", "", None]:
        assert fm.repaired(same) == same


def test_leading_entries():
    assert fm.leading("a: 1\n## b: 2\na: 3\nbody text\nx: y") == ([("a", "1"), ("b", "2")], "body text\nx: y")
    assert fm.leading("") == ([], "")


def test_repair_of_split_words():
    assert repair.joined("the rm al word") == "thermal word" and repair.joined("abc de, word") == "abcde, word"
    assert repair.joined("a b") == "a b"
    assert repair.joined_boldly("Th ermal in sul ation") == "Thermal in sulation"
    assert repair.joined_boldly("the cat\nsat") == "the cat sat"
    assert repair.joined_boldly("") == ""


def test_repair_of_tables():
    text = "x\n| Smith (2001) Jones (1999) | b |\n|---|---|\n| | one |\n| | two |\n| | three |\nend"
    assert repair.tables(text, ["Who"]) == "x\n| Who |  |\n|---|---|\n| Smith (2001) | one |\n| Jones (1999) | two |\nend"
    assert repair.tables("| a | b |\n|---|---|\n| 1 | 2 |") == "| a | b |\n|---|---|\n| 1 | 2 |"


def test_clean(spark):
    rows = [("a.md", 9, "x\nx\nRetrieved from y"), ("b.png", 9, "img"), ("c.txt", 9, "text"), ("wikid.md", 9, "---\ntitle: t\n---\nT\n==\nbody"), ("e.md", 0, ""), ("f.md", 3, None)]
    audit = clean_documents(spark.createDataFrame(rows, "name string, size long, content string"))
    got = {r.name: r for r in audit.collect()}
    assert got["a.md"].cleaned == "x" and got["a.md"].changes == ["removed_boilerplate", "removed_duplicates"]
    assert got["b.png"].removed and got["b.png"].cleaned == "img"
    assert got["c.txt"].skipped and not got["c.txt"].removed
    assert got["wikid.md"].new_name == "d.md" and got["wikid.md"].cleaned == "---\ntitle: t\n---\n# T\nbody"
    stats = clean_stats(audit).first()
    assert (stats.total_files, stats.removed, stats.renamed, stats.skipped) == (6, 2, 1, 1)
    done = process(spark.createDataFrame([(*r, "my_source") for r in rows], "name string, size long, content string, source string"))
    assert {r.name: r.updated for r in done.collect()}["wikid.md"] == "---\nsource: my source\ntitle: t\n---\n# T\nbody"


def test_update_frontmatter_twice(spark):
    df = spark.createDataFrame([("---\ntitle: t\nname: n\n---\nbody", "a_b")], "content string, source string")
    first = update_frontmatter(df).first()
    assert first.updated == "---\nsource: a b\ntitle: t\n---\nbody" and first.updated_fields == ["source"]
    again = update_frontmatter(spark.createDataFrame([(first.updated, "a_b")], "content string, source string")).first()
    assert not again.modified and again.updated_fields == []
