from urllib.parse import urlsplit

from pyspark.sql import functions as F

from corpusloom.functions.links import resolve, without_dots

#: The reference examples of RFC 3986, 5.4 (fixed values).
BASE = "http://a/b/c/d;p?q"
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q",
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_the_reference_examples(spark):
    assert len(EXAMPLES) == 42
    rows = spark.createDataFrame(list(EXAMPLES.items()), "href string, want string")
    got = rows.select("href", "want", resolve(F.lit(BASE), F.col("href")).alias("got")).collect()
    assert [(r.href, r.got) for r in got if r.got != r.want] == []


def test_odd_links(spark):
    cases = [("http://a", "g", "http://a/g"), ("http://a", "../g", "http://a/g"), ("http://a/x//y/../z", "b//c/..", "http://a/x//y/../b//"), ("http://a/b", None, None), (None, "g", None), ("http://a/b#f", "", "http://a/b#f"), ("http://a/é/", "./ü?ö", "http://a/é/ü?ö"), ("http://a/b", "\n", "http://a/\n")]
    rows = spark.createDataFrame(cases, "base string, href string, want string")
    got = {(r.base, r.href): r.got for r in rows.select("*", resolve(F.col("base"), F.col("href")).alias("got")).collect()}
    # A base's own dot segments go with what is merged with it.
    assert got.pop(("http://a/x//y/../z", "b//c/..")) == "http://a/x//b//"
    assert got == {(b, h): w for b, h, w in cases if b != "http://a/x//y/../z"}


def test_paths(spark):
    cases = {"/a/b/c/./../../g": "/a/g", "mid/content=5/../6": "mid/6", "/..": "/", "/.": "/", "..": "", "/a/..": "/", "": "", "/": "/", "//a/./b": "//a/b", "/a//../b": "/a/b"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", without_dots(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in rows} == cases
    assert urlsplit(BASE).path == "/b/c/d;p"
