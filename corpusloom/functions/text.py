"""Column functions on text: trimming, lines, boilerplate, headings, names of files.

All are built-in expressions, so they stay in the JVM. Java's regular
expressions are put in Unix-lines mode where ``.`` and ``^`` should only know
the line feed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that strip() removes: Unicode's and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
#: What ends a line (fixed values).
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

#: Text from the earliest of these on is boilerplate (fixed values).
BOILERPLATE = ["Navigation menu", "Contribute to this page", "###### WHO WE ARE", "###### WHO IS ONE COMMUNITY", "Retrieved from"]
#: Names that hold one of these, in this order, are no pages of text (fixed values).
PAGE_TYPES = ["File:", "Schematic:", "Category:", "Special:", "Template:", "one-community-welcomes"]
#: Lower-cased names that hold one of these, in this order, are no text (fixed values).
FILE_TYPES = (
    ".png .jpg .jpeg .gif .pdf .docx .zip .fcstd .stl .kdenlive .mp4 .mp3 .avi .mov .svg .skp .exe .dmg .iso .tar .gz .rar .7z .csv "
    ".xlsx .pptx .ini .sys .dll .dxf .odt .ods .odp .epub .mobi .dae .fbx .3ds .ino .stp"
).split()
#: Left by the converter of PDF files in its output (fixed value).
CONVERTER_LINE = "Generated by pymupdf4llm"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def lines(c: Column) -> Column:
    """The lines of a text, without an empty one after the last line end."""
    all_lines = F.split(c, LINE_END, -1)
    return F.when(F.element_at(all_lines, -1) == "", F.slice(all_lines, 1, F.size(all_lines) - 1)).otherwise(all_lines)


def quoted(words: list[str]) -> str:
    """A regular expression of the words as they are."""
    return "|".join(re.escape(w).replace(r"\#", "#") for w in words)


def remove_boilerplate(c: Column) -> Column:
    """The text before the earliest indicator, stripped; a text without one as it is."""
    pattern = quoted(BOILERPLATE)
    return F.when(F.regexp_like(c, F.lit(pattern)), strip(F.split(c, pattern, 2)[0])).otherwise(c)


def dedupe_lines(df: DataFrame, text: str, out: str, keep_blank: bool = False) -> DataFrame:
    """``df`` with the column ``out``: the text's lines, each (but for white space at its ends) once, where it is first.

    Blank lines are lines, so one of them remains, unless ``keep_blank``. The
    lines are sorted by key and place and the heads of equal keys kept, which
    takes n log n steps for a text of n lines.
    """
    numbered = F.transform(lines(F.col(text)), lambda x, i: F.struct(strip(x).alias("key"), i.alias("place"), x.alias("line")))
    names = df.columns
    staged = df.withColumn("_sorted", F.array_sort(numbered))
    first = F.filter("_sorted", lambda s, j: (j == 0) | (s["key"] != F.get("_sorted", j - 1)["key"]) | (F.lit(keep_blank) & (s["key"] == "")))
    staged = staged.withColumn("_kept", first)
    ordered = F.array_sort(F.transform("_kept", lambda s: F.struct(s["place"].alias("place"), s["line"].alias("line"))))
    return staged.withColumn(out, F.array_join(F.transform(ordered, lambda s: s["line"]), "\n")).select(*dict.fromkeys([*names, out]))


def standardize_headings(c: Column, strict: bool = False) -> Column:
    """Underlined headings as ``#`` and ``##``; ``strict`` asks for a whole line of at least two marks.

    Without it a list item or rule after a line of text counts as underline, too.
    """
    tail = r"{2,}[ \t]*$" if strict else "+"
    return F.regexp_replace(F.regexp_replace(c, rf"(?md)^(.+)\n={tail}", "# $1"), rf"(?md)^(.+)\n-{tail}", "## $1")


def strip_lines(c: Column) -> Column:
    """Without blank lines and the converter's own, and white space at line ends."""
    kept = F.filter(F.split(c, "\n", -1), lambda x: (strip(x) != "") & ~F.contains(x, F.lit(CONVERTER_LINE)))
    return F.array_join(F.transform(kept, rstrip), "\n")


def reject_reason(name: Column, size: Column) -> Column:
    """Why a file is no text, null if it may be; the first reason that holds."""
    reason = F.when(size == 0, "empty file")
    for kind in PAGE_TYPES:
        reason = reason.when(F.contains(name, F.lit(kind)), f"disallowed page type: {kind}")
    low = F.lower(name)
    for kind in FILE_TYPES:
        reason = reason.when(F.contains(low, F.lit(kind)), f"disallowed file type: {kind}")
    return reason.when(F.startswith(name, F.lit("tag")), "tag file")


def is_markdown(name: Column) -> Column:
    return F.endswith(name, F.lit(".md"))


def wiki_rename(name: Column) -> Column:
    """The name without a leading ``wiki``."""
    return F.when(F.startswith(name, F.lit("wiki")), F.substring(name, 5, 1 << 30)).otherwise(name)


def url_to_filename(url: Column) -> Column:
    """A file name of letters, digits, ``_ - .`` and the suffix .md."""
    return F.concat(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"(?U)[^\w\-_.]", "_"), F.lit(".md"))


def cache_key(path: Column) -> Column:
    """parent/stem of a path."""
    parts = F.split(path, "/")
    return F.concat(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.lit("/"), F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", ""))


def dedupe_description(c: Column) -> Column:
    """A description given twice in a row, its seam without a space, once."""
    words = F.split(c, " ", -1)
    seam = F.array_position(words, F.concat(F.element_at(words, -1), words[0]))
    return F.when(seam > 0, F.array_join(F.concat(F.slice(words, 1, (seam - 1).cast("int")), F.array(F.element_at(words, -1))), " ")).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
