"""Chunking: by headers, by size, by sentences; runs of list items merged; sections and keywords attached.

The size splitter and the header splitter carry state from line to line, so
they are Arrow-batched UDFs that return all chunks of a text; the greedy packer
and the merging of list items are built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from enum import Enum

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.cite import section_path
from corpusloom.functions.frontmatter import extract, fields, get, last_wins
from corpusloom.functions.text import strip
from corpusloom.operators.keywords import extract_keywords
from corpusloom.session import small_batches

SIZE, OVERLAP = 1000, 200
SEPARATORS = ["\n\n", "\n", " ", ""]
LEVELS = 4
#: How a list item starts.
LIST_ITEM = r"^\s*(\d+\.|-|\*)"


class Strategy(Enum):
    """How a text is cut; the command line's default is SIZE."""

    HEADERS = "headers"
    SENTENCES = "sentences"
    SIZE = "size"


def _pieces(text: str, size: int, separators: list[str]) -> list[str]:
    """Cut at the first separator that occurs, each piece but the first beginning with it; longer pieces by the rest."""
    if len(text) <= size:
        return [text] if text else []
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    mark = separators[at]
    if not mark:
        return [text[k : k + size] for k in range(0, len(text), size)]
    first, *rest = text.split(mark)
    out = []
    for piece in [first, *[mark + r for r in rest]]:
        out += [piece] if len(piece) <= size else _pieces(piece, size, separators[at + 1 :])
    return [p for p in out if p]


def split_size(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most ``size`` characters; each begins with the last pieces of the one before, ``overlap`` at most."""
    out, held, total = [], [], 0
    for piece in _pieces(text, size, SEPARATORS):
        if held and total + len(piece) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    out.append("".join(held))
    return [c for c in (x.strip() for x in out) if c]


def split_headers(text: str) -> list[tuple[list[str | None], str]]:
    """(headers of levels 1 to 4, content with its header lines) of each section; fenced code holds no headers."""
    out, headers, held, fence = [], [None] * LEVELS, [], None

    def flush():
        content = "\n".join(held).strip()
        if content:
            out.append((list(headers), content))
        held.clear()

    for line in text.split("\n"):
        mark = re.match(r"\s*(```|~~~)", line)
        if mark and fence in (None, mark[1]):
            fence = None if fence else mark[1]
        found = None if fence or mark else re.match(rf"\s*(#{{1,{LEVELS}}})\s+(.*\S)\s*$", line)
        if found:
            level = len(found[1])
            flush()
            headers[level - 1 :] = [found[2], *[None] * (LEVELS - level)]
        held.append(line)
    flush()
    return out


def chunk_size(size: int = SIZE, overlap: int = OVERLAP):
    """UDF: text to array of chunks."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda t: [] if t is None else split_size(t, size, overlap))

    return run


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("h1", "h2", "h3", "h4", "content")])))
def chunk_headers(c: pd.Series) -> pd.Series:
    """Sections of a text with the headers above them."""
    return c.map(lambda t: [] if t is None else [dict(zip(["h1", "h2", "h3", "h4"], h, strict=True), content=x) for h, x in split_headers(t)])


def pack(units: Column, size: int = SIZE, joiner: str = " ") -> Column:
    """Units (sentences, lines) packed in order while their lengths sum to at most ``size``; none of the chunks is empty."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("total"))

    def step(a: Column, u: Column) -> Column:
        fits = a["now"].isNull() | (a["total"] + F.length(u) <= size)
        return F.struct(
            F.when(fits, a["done"]).otherwise(F.array_append(a["done"], a["now"])).alias("done"),
            F.when(a["now"].isNull() | ~fits, u).otherwise(F.concat(a["now"], F.lit(joiner), u)).alias("now"),
            F.when(a["now"].isNull() | ~fits, F.length(u)).otherwise(a["total"] + F.length(u)).alias("total"),
        )

    return F.filter(F.aggregate(units, start, step, lambda a: F.array_append(a["done"], a["now"])), lambda x: x.isNotNull() & (x != ""))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def merge_short_lists(chunks: Column, size: int = SIZE) -> Column:
    """Chunks that start as list items and are shorter than half of ``size`` take in the next chunk if it is a list too; by position, one each."""
    item = lambda u: F.regexp_like(u, F.lit(LIST_ITEM))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(False).alias("open"))

    def step(a: Column, u: Column) -> Column:
        joined = a["open"] & item(u)
        return F.struct(
            F.when(joined | a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"])).alias("done"),
            F.when(joined, F.concat(a["now"], F.lit("\n"), u)).otherwise(u).alias("now"),
            (~joined & item(u) & (F.length(u) < size / 2)).alias("open"),
        )

    return F.aggregate(chunks, start, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def sentence_chunks(text: Column, size: int = SIZE) -> Column:
    return merge_short_lists(pack(sentences(text), size), size)


def merge_lists(chunks: DataFrame, doc: str, index: str, text: str) -> DataFrame:
    """Runs of chunks that start as list items become one, joined by line feeds; (doc, index of the first, text).

    Gaps and islands within a document; runs have no size limit.
    """
    order = Window.partitionBy(doc).orderBy(index)
    item = F.regexp_like(F.col(text), F.lit(LIST_ITEM))
    goes_on = item & F.coalesce(F.lag(item).over(order), F.lit(False))
    island = F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = chunks.select(doc, index, text).withColumn("_island", island)
    merged = rows.groupBy(doc, "_island").agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))).alias("_x"))
    return merged.select(doc, F.col("_x")[0]["i"].alias(index), F.array_join(F.transform("_x", lambda s: s["t"]), "\n").alias(text))


_LIST = re.compile(LIST_ITEM, re.ASCII)


def merged_lists(chunks: list[str]) -> list[str]:
    """Runs of chunks that start as list items become one, joined by line feeds, as :func:`merge_lists` has them."""
    out, open_list = [], []
    for chunk in chunks:
        if _LIST.match(chunk):
            open_list.append(chunk)
            continue
        out += ["\n".join(open_list)] if open_list else []
        open_list = []
        out.append(chunk)
    return out + (["\n".join(open_list)] if open_list else [])


def cut(text: str, strategy: Strategy, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[list[str | None], str]]:
    """(headers, content) of a text's chunks in order, by headers and size or by size alone."""
    if strategy is Strategy.HEADERS:
        return [(headers, piece) for headers, section in split_headers(text) for piece in split_size(section, size, overlap)]
    return [([None] * LEVELS, piece) for piece in merged_lists(split_size(text, size, overlap))]


_HEADS = [f"h{k}" for k in range(1, LEVELS + 1)]


Cutter = Callable[[str], list[tuple[list[str | None], str]]]


def cut_udf(cutter: Cutter):
    """UDF: text to an array of chunks with the headers above them; of a text that ``cutter`` fails on, one entry with its ``error``."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in (*_HEADS, "content", "error")])))
    def run(c: pd.Series) -> pd.Series:
        def one(t):
            try:
                return [dict(zip(_HEADS, h, strict=True), content=x, error=None) for h, x in cutter(t)]
            except Exception as e:  # whatever is wrong with one text must not end the job
                return [dict.fromkeys(_HEADS) | {"content": None, "error": f"{type(e).__name__}: {e}"}]

        return c.map(lambda t: [] if t is None else one(t))

    return run


def chunk_id(path: Column, index: Column, content: Column) -> Column:
    """The same chunk has the same id in every run."""
    return F.sha2(F.concat_ws("\x1f", path, index.cast("string"), content).cast("binary"), 256)


def chunk_documents(docs: DataFrame, path: str = "path", text: str = "text", strategy: Strategy | str = Strategy.HEADERS, size: int = SIZE, overlap: int = OVERLAP, keywords: bool = True, errors: bool = False, cutter: Cutter | None = None) -> DataFrame:
    """path, chunk_index, page_content, headers h1 to h4, section_path, frontmatter (as text), metadata, keywords and chunk_id of each chunk.

    ``metadata`` (array of key and value) has the headers as header_1 to
    header_4 and the frontmatter's entries, which go before headers of the same
    name; ``section_path`` is made of what it has. Without ``keywords`` there is
    no such column, else keywords of the frontmatter give way to it.

    A text's chunks are cut and numbered where the text lies, so there is no
    shuffle; rows with equal paths are numbered apart.

    A text that can't be cut ends the job, or, with ``errors``, is one row whose
    column ``error`` tells why and whose index and content are null. So does a
    chunk whose keywords can't be worked out; with ``errors`` it keeps its index,
    content and id, and its keywords are null. ``cutter`` takes the place of the
    cuts by headers and size. The session's Arrow batches are bounded
    (:func:`corpusloom.session.small_batches`).
    """
    strategy = Strategy(strategy)
    small_batches(docs.sparkSession)
    parts = docs.select(F.col(path).alias("path"), extract(F.coalesce(F.col(text), F.lit(""))).alias("x")).select("path", "x.block", "x.body")
    parts = parts.withColumn("entries", fields(F.col("block"))).withColumn("front", last_wins(F.col("entries"))).drop("entries")  # once for each document
    if strategy is Strategy.SENTENCES and cutter is None:
        none = [F.lit(None).cast("string").alias(h) for h in _HEADS]
        numbered = parts.select("path", "block", "front", F.posexplode(sentence_chunks(F.col("body"), size)).alias("chunk_index", "page_content")).select("*", F.lit(None).cast("string").alias("error"), *none)
    else:
        found = parts.select("path", "block", "front", F.posexplode(cut_udf(cutter or (lambda t: cut(t, strategy, size, overlap)))("body")).alias("chunk_index", "s"))
        known = F.col("chunk_index") if errors else F.when(F.col("s.error").isNotNull(), F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("s.error")))).otherwise(F.col("chunk_index"))
        known = F.when(F.col("s.error").isNull(), known) if errors else known
        numbered = found.select("path", "block", "front", known.alias("chunk_index"), F.col("s.content").alias("page_content"), F.col("s.error").alias("error"), *[F.col(f"s.{h}").alias(h) for h in _HEADS])
    named = F.array(*[F.struct(F.lit(f"header_{k}").alias("key"), F.col(h).alias("value")) for k, h in enumerate(_HEADS, 1)])
    own = F.filter(named, lambda p: p["value"].isNotNull() & ~F.exists("front", lambda q: q["key"] == p["key"]))
    front = F.filter("front", lambda p: p["key"] != "keywords") if keywords else F.col("front")
    path_of = section_path(*[F.coalesce(get(F.col("front"), f"header_{k}"), F.col(h)) for k, h in enumerate(_HEADS, 1)])
    out = numbered.select("path", "chunk_index", "page_content", *_HEADS, path_of.alias("section_path"), F.col("block").alias("frontmatter"), F.concat(own, front).alias("metadata"), *(["error"] if errors else []))
    if keywords and errors:
        out = out.withColumn("_k", extract_keywords(F.col("page_content"), errors=True))
        out = out.withColumn("error", F.coalesce("error", F.concat(F.lit("keywords: "), F.col("_k.error")))).withColumn("keywords", F.col("_k.keywords")).drop("_k")
    elif keywords:
        out = out.withColumn("keywords", extract_keywords(F.col("page_content")))
    name = chunk_id(F.col("path"), F.col("chunk_index"), F.col("page_content"))
    return out.withColumn("chunk_id", F.when(F.col("page_content").isNotNull(), name)) if errors else out.withColumn("chunk_id", name)
