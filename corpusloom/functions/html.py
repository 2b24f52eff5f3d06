"""Column functions on HTML: meta tags, page metadata, links, chrome, Markdown, plain text.

Rules are (pattern, replacement) pairs applied one after another by
``regexp_replace``; patterns use what Java's and RE2's engines share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are no content (fixed values).
CHROME = ["script", "nav", "header", "footer-widgets", "footer"]

_DROP = [(f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>", "") for tag in CHROME]
_UNSEEN = [(r"(?is)<!--.*?-->", ""), (r"(?is)<!doctype[^>]*>", ""), (r"(?is)<style(?:\s[^>]*)?>.*?</style\s*>", "")]
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]

STRIP_CHROME = _DROP
MARKDOWN = [
    *_UNSEEN,
    (r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>", ""),
    (r"(?is)<title(?:\s[^>]*)?>.*?</title\s*>", ""),
    (r"\s+", " "),
    *[(rf"(?i)<h{n}(?:\s[^>]*)?>\s*(.*?)\s*</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)],
    (r'(?i)<a(?:\s[^>]*)?\shref="([^"]*)"[^>]*>(.*?)</a\s*>', "[$2]($1)"),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
    (r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "*"),
    (r"(?i)</?code(?:\s[^>]*)?>", "`"),
    (r"(?i)<br\s*/?>", "  \n"),
    (r"(?i)<li(?:\s[^>]*)?>\s*", "\n* "),
    (r"(?i)</?(?:p|div|ul|ol|table|article|section|blockquote|pre)(?:\s[^>]*)?>", "\n\n"),
    (r"(?i)</tr\s*>", "\n"),
    (r"(?i)</t[dh]\s*>", " | "),
    (r"<[^>]*>", ""),
    *_ENTITIES,
    (r"[ \t]+\n", "\n"),
    (r"\n[ \t]+", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"^\s+", ""),
    (r"\s+$", ""),
]
PLAIN = [
    *_UNSEEN, *_DROP, (r'(?is)<a(?:\s[^>]*)?\shref="[^"]*"[^>]*>.*?</a\s*>', "\n"),
    (r"<[^>]*>", "\n"), *_ENTITIES, (r"[ \t]*\n\s*", "\n"), (r"^\s+", ""), (r"\s+$", ""),
]


def apply(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, c)


def strip_chrome(c: Column) -> Column:
    """Without navigation, headers, footers and scripts."""
    return apply(c, STRIP_CHROME)


def to_markdown(c: Column) -> Column:
    return apply(c, MARKDOWN)


def plain_text(c: Column) -> Column:
    """Text alone, a line for each run; links are left out."""
    return apply(c, PLAIN)


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(F.regexp_like(tag, F.lit(rf"(?is)\s{name}\s*=\s*[\"']")), value)


def meta_tags(c: Column) -> Column:
    """array<struct<key, value>> of meta tags: by ``name``, else ``source``, else ``http-equiv-…``."""
    tags = F.regexp_extract_all(c, F.lit(r"(?is)(<meta\s[^>]*>)"), 1)
    key = lambda t: F.coalesce(_attribute(t, "name"), _attribute(t, "source"), F.concat(F.lit("http-equiv-"), _attribute(t, "http-equiv")))
    return F.filter(F.transform(tags, lambda t: F.struct(key(t).alias("key"), F.coalesce(_attribute(t, "content"), F.lit("")).alias("value"))), lambda p: p["key"].isNotNull())


def meta(c: Column, key: str) -> Column:
    """The last content of a meta tag, empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(meta_tags(c), lambda p: p["key"] == key), F.lit(-1))["value"], F.lit(""))


def title(c: Column) -> Column:
    return F.regexp_extract(c, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)


def hrefs(c: Column) -> Column:
    """The links of a page."""
    return F.regexp_extract_all(c, F.lit(r'(?is)<a\s(?:[^>]*\s)?href="([^"]*)"'), 1)


def metadata_fields(title: Column, author: Column, description: Column, url: Column, source: Column, license: Column, day: Column) -> dict[str, Column]:
    """Seven strings about a page; colons become `` -`` but in the url. ``day`` is given, so results don't change by date."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(":"), F.lit(" -"))
    return {"source": plain(source), "title": plain(title), "author": plain(author), "url": F.coalesce(url, F.lit("")), "access_date": plain(day), "license": plain(license), "description": plain(description)}


def page_metadata(html: Column, url: Column, source: Column, license: Column, day: Column) -> dict[str, Column]:
    """:func:`metadata_fields` of a page's html, by expressions alone."""
    return metadata_fields(title(html), meta(html, "author"), meta(html, "description"), url, source, license, day)
