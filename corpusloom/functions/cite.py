"""Column functions for citations: header chains, citation texts, contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

#: What precedes the sources in a prompt, and stands for none in a panel (fixed values).
INSTRUCTION = "Use the following context to answer the query. When using information from the context, cite the source number (e.g., [1]):"
NO_SOURCES = "No sources retrieved."


def known(c: Column) -> Column:
    """The text ``None`` is no value."""
    return F.when(c != "None", c)


def section_path(*headers: Column) -> Column:
    """Non-empty headers joined by `` > ``, null if there is none."""
    path = F.concat_ws(" > ", *[F.when(h != "", h) for h in headers])
    return F.when(path != "", path)


def header_chain(levels: list[Column], other_levels: list[Column], single: Column) -> Column:
    """The headers of the first of three families that has any, each once, joined by `` > ``."""
    full = lambda cs: F.filter(F.array(*[strip(known(c)) for c in cs]), lambda x: x.isNotNull() & (x != ""))
    families = [full(levels), full(other_levels), full([single])]
    chosen = F.when(F.size(families[0]) > 0, families[0]).when(F.size(families[1]) > 0, families[1]).otherwise(families[2])
    return F.when(F.size(chosen) > 0, F.array_join(F.array_distinct(chosen), " > "))


def citation(number: Column, source: Column, title: Column, header: Column, url: Column, page: Column, file_path: Column, path: Column | None = None) -> Column:
    """The struct of one citation; an empty url counts as one, an empty source or title doesn't."""
    named = lambda c: F.coalesce(F.when(known(c) != "", c), F.lit("Unknown"))
    url, page, file_path = known(url), known(page), known(file_path)
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] "))
    name = F.concat(named(source), F.lit(": "), named(title))
    text = F.concat(
        head, name, F.lit(", "), F.when(header != "", F.concat(F.lit("Section: "), header, F.lit(", "))).otherwise(""),
        F.coalesce(F.concat(F.lit("URL: "), url, F.lit(", ")), F.lit("")), F.coalesce(F.concat(F.lit("Page: "), page, F.lit(", ")), F.lit("")),
    )
    files = [F.when(file_path != "", file_path), *([F.when(known(path) != "", path)] if path is not None else []), F.lit("Unknown")]
    return F.struct(
        number.alias("source_number"), named(source).alias("source"), named(title).alias("title"), header.alias("header"), url.alias("url"), page.alias("page"),
        F.coalesce(*files).alias("file"), file_path.alias("file_path"), F.regexp_replace(text, r"[, ]+\z", "").alias("citation_text"),
        F.when(url.isNotNull(), F.concat(head, F.lit("["), name, F.lit("]("), url, F.lit(")"))).alias("hyperlink_citation"),
    )


def citation_line(c: Column, content: Column | None = None) -> Column:
    """The hyperlink if there is one, else the text; then the content on lines of its own."""
    line = F.coalesce(F.when(c["hyperlink_citation"] != "", c["hyperlink_citation"]), c["citation_text"], F.lit(""))
    return line if content is None else F.concat(line, F.when(content != "", F.concat(F.lit("\n"), content)).otherwise(""))


def in_order(rank: Column, line: Column, between: str) -> Column:
    """An aggregate: lines of a group by rank, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), line.alias("line")))), lambda x: x["line"]), between)


def prompt(question: Column, context: Column) -> Column:
    return F.concat(question, F.lit(f"\n\n{INSTRUCTION}\n\n"), context)


def panel(lines: Column) -> Column:
    """The panel of sources of a group's joined lines."""
    return F.when(F.coalesce(lines, F.lit("")) == "", NO_SOURCES).otherwise(F.concat(F.lit("**Sources:**\n\n"), lines))
