"""Repair of text taken from PDF files: split words and broken tables.

What a step does depends on the step before it, so these are Arrow-batched UDFs
over whole texts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Short words that are no fragments (fixed values).
SHORT_WORDS = frozenset(
    """a an as at am be by do go he hi if in is it me my no of on or ox so to up us we
    and are but can car cat cow day did dog eat end far few for get got had has her
    him his hot how its let may new not now odd off old one our out own per put ran
    red run saw say see set she sir sit six ten the too top try two use was way who
    why win yes yet you via etc age add""".split()
)
_MARKS = ".,;:!?()\"'"
#: A run of three short pieces, or of two whose second is shorter still.
_RUNS = re.compile(r"\b(\w{1,3})\s+(\w{1,3})\s+(\w{1,3})\b|\b(\w{1,3})\s+(\w{1,2})\b")
#: Pieces make a word from this length on; longer pieces are words of their own.
WORD, PIECE, MOST = 4, 3, 4


def joined(text: str) -> str:
    """Runs of short pieces that make a word of four letters or more, without their spaces."""

    def one(match: re.Match) -> str:
        word = "".join(g for g in match.groups() if g)
        return word if len(word) >= WORD else match[0]

    return _RUNS.sub(one, text)


def _core(token: str) -> str:
    return token.lower().strip(_MARKS)


def joined_boldly(text: str) -> str:
    """Fragments that are no short words absorb up to three tokens after them; tokens are joined by single spaces."""
    tokens, out, at = text.split(), [], 0
    while at < len(tokens):
        end, core = at + 1, _core(tokens[at])
        if len(core) <= PIECE and core not in SHORT_WORDS:
            while end < min(len(tokens), at + MOST) and _core(tokens[end]) not in SHORT_WORDS:
                end += 1
                if len(_core(tokens[end - 1])) > PIECE:
                    break
        word = "".join(tokens[at:end])
        if end - at > 1 and len(word.strip(_MARKS)) < WORD:
            word, end = tokens[at], at + 1
        out.append(word)
        at = end
    return " ".join(out)


def _cells(row: str) -> list[str]:
    """A row's cells without the empty ones outside its bars."""
    cells = [c.strip() for c in row.split("|")]
    return cells[bool(not cells[0]) : len(cells) - (not cells[-1])] if len(cells) > 1 else cells


def tables(text: str, names: list[str] | None = None) -> str:
    """Tables whose header holds citations get a header of names, and each row its citation first.

    Rows beyond the citations are left out.
    """
    lines, out, at = text.split("\n"), [], 0
    while at < len(lines):
        follows = lines[at + 1] if at + 1 < len(lines) else ""
        head = [c.strip() for c in lines[at].split("|") if c.strip()]
        if "|" not in lines[at] or "|---" not in follows or not head or not re.search(r"\((19|20)", head[0]):
            out.append(lines[at])
            at += 1
            continue
        width = follows.count("|") - 1
        titles = ((names or []) + [""] * width)[:width]
        out += [f"| {' | '.join(titles)} |", "|" + "---|" * width]
        at += 2
        citations = iter(re.split(r"\s+(?=[A-Z])", head[0]))
        while at < len(lines) and lines[at].startswith("|"):
            if (citation := next(citations, None)) is not None:
                cells = [c for c in _cells(lines[at]) if c]
                out.append(f"| {' | '.join([citation, *(cells + [''] * width)[: width - 1]])} |")
            at += 1
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def fix_spaces(c: pd.Series) -> pd.Series:
    return c.map(joined, na_action="ignore")


@F.pandas_udf(T.StringType())
def fix_spaces_boldly(c: pd.Series) -> pd.Series:
    return c.map(joined_boldly, na_action="ignore")


def fix_tables(names: list[str] | None = None):
    """A UDF with the given column names."""

    @F.pandas_udf(T.StringType())
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda t: tables(t, names), na_action="ignore")

    return run
