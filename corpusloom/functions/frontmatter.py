"""Frontmatter: ``key: value`` lines between two ``---`` at the head of a document.

Reading and writing are built-in expressions. The repair of a misplaced
delimiter depends on what came before, line by line; it is an Arrow-batched UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import standardize_headings, strip

#: Known keys in the order they are written (fixed values).
KEYS = ["source", "title", "author", "url", "access_date", "date", "license", "description", "keywords"]
#: Lines of a document in which its frontmatter is looked for, and the line by which it is not over yet.
HEAD_LINES, EARLY = 25, 5


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once a row however often it is named; an expression is worked out anew wherever it stands."""
    return F.transform(F.array(value), use)[0]


def _value(key: Column, value: Column) -> Column:
    value = F.regexp_replace(F.regexp_replace(value, "^[\"']", ""), "[\"']$", "")
    plain = F.when(key.isin("title", "description"), F.replace(value, F.lit(":"), F.lit(" -"))).otherwise(value)
    return F.when((key == "url") & F.startswith(plain, F.lit("https -")), F.replace(plain, F.lit("https -"), F.lit("https:"))).otherwise(plain)


def entries(block: Column) -> Column:
    """array<struct<key, value>> of a block's lines; comment lines and lines without a colon are left out."""
    kept = F.filter(F.split(strip(block), "\n"), lambda x: ~F.contains(x, F.lit("##")) & F.contains(x, F.lit(":")))
    pairs = F.transform(kept, lambda x: F.struct(strip(F.split(x, ":", 2)[0]).alias("key"), strip(F.split(x, ":", 2)[1]).alias("value")))
    return F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), _value(p["key"], p["value"]).alias("value")))


def fields(block: Column) -> Column:
    """array<struct<key, value>> of all of a block, values as written but for quotes around them; lines that begin no key go on with the value before."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(block, F.lit("")), r"\r\n?", "\n"), r"(?m)^\s*#.*$", "")
    pieces = F.filter(F.split(lines, r"\n(?=[^\s#:-][^\n:]*:(?:\s|\z))"), lambda x: F.regexp_like(x, F.lit(r"\A\s*[^\s:][^\n:]*:(?:\s|\z)")))
    pairs = F.transform(pieces, lambda x: F.struct(strip(F.split(x, ":", 2)[0]).alias("key"), strip(F.split(x, ":", 2)[1]).alias("value")))
    quoted = lambda v: F.regexp_like(v, F.lit(r"""(?s)\A(?:"[^"]*"|'[^']*')\z"""))
    return F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), F.when(quoted(p["value"]), F.substring(p["value"], F.lit(2), F.length(p["value"]) - 2)).otherwise(p["value"]).alias("value")))


def last_wins(pairs: Column) -> Column:
    """Entries with a key's last value, at its first place."""
    keys = lambda ps: F.array_distinct(F.transform(ps, lambda p: p["key"]))
    return _once(pairs, lambda ps: F.transform(keys(ps), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(ps, lambda p: p["key"] == k), -1)["value"].alias("value"))))


def _parts(c: Column) -> Column:
    return F.split(c, "---", 3)


def has_frontmatter(c: Column) -> Column:
    return F.startswith(c, F.lit("---")) & (F.size(_parts(c)) == 3)


def parse(c: Column) -> Column:
    """struct<entries, body>: no entries and the whole text if there is no frontmatter."""
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    whole = F.struct(none.alias("entries"), c.alias("body"))
    return _once(F.when(F.startswith(c, F.lit("---")), _parts(c)), lambda parts: F.when(F.size(parts) == 3, F.struct(last_wins(entries(parts[1])).alias("entries"), parts[2].alias("body"))).otherwise(whole))


def get(pairs: Column, key: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(1))["value"]


def build(pairs: Column) -> Column:
    """Lines of the known keys in their order, then of the others in theirs."""
    ordered = lambda ps: F.concat(*[_only(ps, k) for k in KEYS], F.filter(ps, lambda p: ~p["key"].isin(KEYS)))
    return F.array_join(F.transform(_once(pairs, ordered), lambda p: F.concat(p["key"], F.lit(": "), p["value"])), "\n")


def _only(pairs: Column, key: str) -> Column:
    return F.filter(pairs, lambda p: p["key"] == key)


def document(pairs: Column, body: Column) -> Column:
    """Frontmatter and body; no block without entries."""
    return _once(pairs, lambda ps: F.when(F.size(ps) == 0, body).otherwise(F.concat(F.lit("---\n"), build(ps), F.lit("\n---"), body)))


def canonical(pairs: Column, source: Column, extra: dict[str, Column] | None = None) -> Column:
    """Known keys alone, the source's underscores as spaces, the description once, ``extra`` laid over."""
    from corpusloom.functions.text import dedupe_description

    extra = extra or {}
    over = {"source": F.replace(source, F.lit("_"), F.lit(" "))} | extra
    kept = F.filter(pairs, lambda p: p["key"].isin([k for k in KEYS if k not in over]))
    once = F.transform(kept, lambda p: F.struct(p["key"].alias("key"), F.when(p["key"] == "description", dedupe_description(p["value"])).otherwise(p["value"]).alias("value")))
    return F.concat(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in over.items()]), once)


def changed_keys(before: Column, after: Column) -> Column:
    """Keys whose value is another one after, in the order after."""
    same = lambda p, olds: F.exists(olds, lambda q: (q["key"] == p["key"]) & (q["value"] == p["value"]))
    return F.transform(_once(before, lambda olds: F.filter(after, lambda p: ~same(p, olds))), lambda p: p["key"])


def extract(c: Column) -> Column:
    """struct<block, body> of a whole ``---`` block at the text's start; a null block if there is none."""
    pattern = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
    found = F.regexp_like(c, F.lit(pattern))
    return F.struct(F.when(found, F.regexp_extract(c, pattern, 1)).alias("block"), F.when(found, F.regexp_replace(c, pattern, "")).otherwise(c).alias("body"))


_KEY = re.compile(rf"({'|'.join(KEYS)}):")


def _belongs(lines: list[str], at: int) -> bool | None:
    """Whether a line is frontmatter; None if the text has begun before it."""
    line = lines[at].strip()
    if _KEY.match(line):
        return True
    after = lines[at + 1].strip() if at + 1 < len(lines) else ""
    if ":" in line or not after:
        return False
    if "url:" in after:
        return True
    if "http:" in after or "https:" in after or (":" not in after and "---" in after):
        return None
    return False


def repaired(text: str | None) -> str | None:
    """A ``---`` that cuts a value in two within the first lines is moved after the frontmatter.

    The rest of the value rejoins it with a space, and keys lose leading marks
    of headings. Any other text stays as it is.
    """
    if text is None:
        return None
    lines = text.split("\n")
    marks = [k for k, line in enumerate(lines[:HEAD_LINES]) if line.strip() == "---"]
    if lines[0].strip() != "---" or len(marks) < 2 or marks[1] >= EARLY:
        return text
    cut, last, limit = marks[1], None, min(len(lines), HEAD_LINES)
    for k in range(cut + 1, limit):
        if not lines[k].strip():
            continue
        verdict = _belongs(lines, k)
        if verdict is None:
            break
        if verdict:
            last = k
    if last is None:
        return text
    begins = lambda line: line and ":" not in line and not line.startswith("##")
    end = next((k for k in range(last + 1, limit) if begins(lines[k].strip())), last + 1)
    head = lines[:cut]
    rest = lines[cut + 1 : end]
    if rest and rest[0].strip() and not rest[0].split()[0].endswith(":"):
        head[-1] += f" {rest.pop(0).strip()}"
    head += rest
    plain = [re.sub(r"^(\s*)#+\s*", r"\1", line) if line.lstrip().startswith("##") and ":" in line else line for line in head]
    return "\n".join([*plain, "---", *lines[end:]])


@F.pandas_udf(T.StringType())
def fix_yaml_delimiters(c: pd.Series) -> pd.Series:
    """:func:`repaired` of each text."""
    return c.map(repaired, na_action="ignore")


def leading(text: str) -> tuple[list[tuple[str, str]], str]:
    """Entries of the leading lines that look like frontmatter (a key's first value counts), and the text after them."""
    lines, out, k = text.split("\n"), {}, 0
    for k, line in enumerate([*lines, None]):
        if line is None or (":" not in line and "---" not in line) or (re.search("https?:", line) and not line.lstrip("# ").startswith("url:")):
            break
        if "---" not in line:
            key, _, value = line.lstrip("#").partition(":")
            out.setdefault(key.strip(), value.strip())
    return list(out.items()), "\n".join(lines[k:])


@F.pandas_udf(T.StructType([T.StructField("frontmatter", T.StringType()), T.StructField("body", T.StringType())]))
def fix_frontmatter_parts(c: pd.Series) -> pd.DataFrame:
    done = [leading(repaired(t)) if t is not None else (None, None) for t in c]
    return pd.DataFrame({"frontmatter": [None if e is None else "\n".join(f"{k}: {v}" for k, v in e) for e, _ in done], "body": [b for _, b in done]})


def fix_frontmatter(c: Column) -> Column:
    """struct<frontmatter, body>: repaired leading entries, and the body with standard headings."""
    parts = fix_frontmatter_parts(c)
    return F.struct(parts["frontmatter"].alias("frontmatter"), standardize_headings(parts["body"]).alias("body"))
