"""Column functions on links: roots, joins, filters, page names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import FILE_TYPES, PAGE_TYPES

#: As file types, but for the dot, which only this one keeps (fixed value).
LINK_FILE_TYPES = [t if t == ".rar" else t[1:] for t in FILE_TYPES]
LINK_PAGE_TYPES = [*PAGE_TYPES, "/tag/"]


def site_root(url: Column) -> Column:
    """scheme://host/"""
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1), F.lit("/"))


def robots_url(url: Column) -> Column:
    """robots.txt lies at the site's root, not below the page."""
    return F.concat(site_root(url), F.lit("robots.txt"))


#: A reference's scheme, authority, path, query and fragment, each with its mark (fixed value: RFC 3986, appendix B).
_PARTS = r"^(?:([^:/?#]+:))?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?"


def _part(c: Column, k: int) -> Column:
    return F.regexp_extract(c, f"(?s){_PARTS}", k)


def without_dots(path: Column) -> Column:
    """A path without segments ``.`` and ``..``: a stack of its segments, from which ``..`` takes the last (RFC 3986, 5.2.4)."""
    rooted = F.startswith(path, F.lit("/"))
    segments = F.split(F.when(rooted, F.substring(path, 2, 1 << 30)).otherwise(path), "/", -1)

    def step(stack: Column, segment: Column) -> Column:
        up = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(segment == ".", stack).when(segment == "..", up).otherwise(F.array_append(stack, segment))

    stack = F.aggregate(segments, F.expr("cast(array() as array<string>)"), step)
    last = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(stack, F.lit(""))).otherwise(stack)  # these name a folder
    plain = ~F.regexp_like(path, F.lit(r"(^|/)\.\.?(/|$)"))
    return F.when(plain, path).otherwise(F.concat(F.when(rooted, "/").otherwise(""), F.array_join(last, "/")))


def resolve(base: Column, href: Column) -> Column:
    """A link as seen from ``base``, by RFC 3986 (5.2.2, strict); an empty one is the base, its fragment included; null if one of them is."""
    scheme, authority, path, query, fragment = (_part(href, k) for k in range(1, 6))
    b_scheme, b_authority, b_path, b_query = (_part(base, k) for k in range(1, 5))
    beside = F.when((b_authority != "") & (b_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_replace(b_path, "[^/]*$", ""), path))
    own = F.when(F.startswith(path, F.lit("/")), path).otherwise(beside)
    return (
        F.when(href.isNull() | base.isNull(), None)
        .when(href == "", base)
        .when(scheme != "", F.concat(scheme, authority, without_dots(path), query, fragment))
        .when(authority != "", F.concat(b_scheme, authority, without_dots(path), query, fragment))
        .when(path == "", F.concat(b_scheme, b_authority, b_path, F.when(query != "", query).otherwise(b_query), fragment))
        .otherwise(F.concat(b_scheme, b_authority, without_dots(own), query, fragment))
    )


def basic_filter(url: Column, base: Column) -> Column:
    """On the site, and neither a query nor a fragment."""
    return F.startswith(url, base) & ~F.contains(url, F.lit("#")) & ~F.contains(url, F.lit("?"))


def link_filter(url: Column, base: Column, suffix_only: bool = False) -> Column:
    """As :func:`basic_filter`, and neither a file nor a special page.

    A file type counts anywhere in what follows the last dot, or, with
    ``suffix_only``, only if it is all of it.
    """
    end = F.element_at(F.split(F.lower(url), r"\."), -1)
    file = end.isin([t.lstrip(".") for t in LINK_FILE_TYPES]) if suffix_only else F.exists(F.array(*map(F.lit, LINK_FILE_TYPES)), lambda t: F.contains(end, t))
    page = F.exists(F.array(*map(F.lit, LINK_PAGE_TYPES)), lambda t: F.contains(url, t))
    return basic_filter(url, base) & ~file & ~page


def page_name(url: Column) -> Column:
    """The path without slashes (``index`` if empty), without a leading ``wiki``, and .md."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    name = F.replace(path, F.lit("/"), F.lit(""))
    name = F.when(name == "", "index").otherwise(name)
    return F.concat(F.when(F.startswith(name, F.lit("wiki")) & (F.length(name) > 4), F.substring(name, 5, 1 << 30)).otherwise(name), F.lit(".md"))


def source_folder(source: Column) -> Column:
    return F.replace(source, F.lit(" "), F.lit("_"))
