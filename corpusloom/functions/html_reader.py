"""HTML read by a tokenizer with a stack of open elements, in Arrow batches.

One pass over a page gives its title, meta tags, links, Markdown and plain text.
Unlike rules on the text, the stack knows what is nested: a ``nav`` within a
``nav``, lists in lists with their numbers, cells in rows, and which elements an
end tag or the start of another one closes.

Markdown: ATX headings; ``*`` and numbered items, nested ones indented; code
blocks in fences with their lines as they are; tables with a header row where the
page has one, else an empty one; quotes; links, images, bold, italics, code.
Navigation, headers, footers, scripts, styles and titles are left out of it, with
all that is in them. Characters that Markdown reads as marks are not escaped.

Defined results: null is null; an empty page has empty values; unclosed elements
end with what they are in, end tags without a start are passed over; a page of any
depth is read, without recursion.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.html import CHROME

_META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("metas", T.ArrayType(_META)), T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("markdown", T.StringType()), T.StructField("text", T.StringType()),
])
_DROPPED = frozenset([*CHROME, "style", "template", "noscript", "title"])
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = {f"h{k}": "#" * k for k in range(1, 7)}
_BLOCKS = frozenset([*_HEADINGS, *"address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure form html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()])
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
#: What the start of an element closes if it is open, and the elements that such a search does not leave.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: A line break within running text, until the text is put together.
_BREAK = "\v"


class _Open:
    """An open element: ``blocks`` it holds so far, and the running ``text`` since the last of them."""

    __slots__ = ("tag", "attrs", "blocks", "text", "count")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.blocks, self.text = tag, attrs, [], []
        start = attrs.get("start") or ""
        self.count = int(start) - 1 if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 0


def _running(parts: list[str]) -> str:
    """Text put together, its white space collapsed, line breaks as Markdown has them."""
    text = re.sub(" +", " ", "".join(parts))
    return re.sub(rf" ?{_BREAK} ?", "  \n", text.strip(f" {_BREAK}"))


class Reader(HTMLParser):
    """Feed a page, close, then read ``result()``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", {})]
        self.names: dict[str, int] = {}  # how often each element is open
        self.dropped = 0  # open elements that are left out
        self.titles: list[str] = []
        self.metas: list[dict[str, str]] = []
        self.links: list[str] = []
        self.lines: list[str] = []

    # ------------------------------------------------------------ events
    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))  # of repeated attributes the first counts
        if tag == "meta":
            self._meta(attrs)
        elif tag == "a" and attrs.get("href") is not None:
            self.links.append(attrs["href"])
        if tag in _VOID:
            self._void(tag, attrs)
            return
        if tag in _CLOSES:
            self._close_open(*_CLOSES[tag])
        if tag in _BLOCKS:
            if self.names.get("p"):
                self._close_open({"p"}, {"table", "li", "blockquote", "td", "th"})
            self._end_run()
        self.open.append(_Open(tag, attrs))
        self.names[tag] = self.names.get(tag, 0) + 1
        self.dropped += tag in _DROPPED

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.names.get(tag):
            # A list, table or chrome element in between is closed with what is around it, but not by its own contents.
            while self.open[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.names.get("title") and self.open[-1].tag == "title":
            self.titles.append(_SPACE.sub(" ", data))
        if self.dropped:
            return
        if not self.names.get("a") and (line := _SPACE.sub(" ", data).strip()):
            self.lines.append(line)
        self.open[-1].text.append(data if self.names.get("pre") else _SPACE.sub(" ", data))

    # ------------------------------------------------------------ elements
    def _meta(self, attrs):
        key = next((attrs[a] for a in ("name", "source") if attrs.get(a) is not None), None)
        if key is None and attrs.get("http-equiv") is not None:
            key = f"http-equiv-{attrs['http-equiv']}"
        if key is not None:
            self.metas.append({"key": key, "value": attrs.get("content") or ""})

    def _void(self, tag, attrs):
        if self.dropped:
            return
        if tag == "br":
            self.open[-1].text.append("\n" if self.names.get("pre") else _BREAK)
        elif tag == "hr":
            self._end_run()
            self._block("---")
        elif tag == "img" and attrs.get("src"):
            self.open[-1].text.append(f"![{_running([attrs.get('alt') or ''])}]({attrs['src']})")

    def _close_open(self, tags: set[str], limits: set[str]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``limits`` is nearer."""
        if not any(self.names.get(t) for t in tags):
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                while len(self.open) > at:
                    self._close()
                return
            if self.open[at].tag in limits:
                return

    def _end_run(self) -> None:
        """Running text ends where a block begins or ends; within inline elements and cells a space does."""
        top = self.open[-1]
        if top.tag in _BLOCKS or not top.tag:
            if top.tag != "pre" and (text := _running(top.text)):
                top.blocks.append(text)
            if top.tag != "pre":
                top.text = []
        else:
            top.text.append(" ")

    def _block(self, block: str) -> None:
        top = self.open[-1]
        if top.tag in _BLOCKS or not top.tag:
            top.blocks.append(block)
        else:
            top.text.append(f" {block} ")

    def _close(self) -> None:
        if self.open[-1].tag in _BLOCKS:
            self._end_run()
        one = self.open.pop()
        self.names[one.tag] -= 1
        if one.tag in _DROPPED:
            self.dropped -= 1
            return
        if self.dropped:
            return
        if one.tag not in _BLOCKS:
            self._inline(one)
        elif one.tag == "pre":
            self._code(one)
        elif one.tag in _HEADINGS:
            text = " ".join(_SPACE.sub(" ", b) for b in self._plain(one.blocks))
            if text:
                self._block(f"{_HEADINGS[one.tag]} {text}")
        elif one.tag in ("td", "th"):
            self.open[-1].blocks.append((one.tag, " ".join(_SPACE.sub(" ", b) for b in self._plain(one.blocks)).replace("|", "\\|")))
        elif one.tag == "tr":
            cells = [b for b in one.blocks if isinstance(b, tuple)]
            if cells:
                self.open[-1].blocks.append(("tr", [c[1] for c in cells], all(c[0] == "th" for c in cells)))
        elif one.tag in ("thead", "tbody", "tfoot"):
            head = one.tag == "thead"
            self.open[-1].blocks += [("tr", b[1], b[2] or head) if isinstance(b, tuple) and b[0] == "tr" else b for b in one.blocks]
        elif one.tag == "table":
            self._table(one)
        elif one.tag == "li":
            self._item(one)
        elif one.tag in ("ul", "ol"):
            items = [b for b in one.blocks if isinstance(b, str)]
            if items:
                self._block("\n".join(items))
        elif one.tag == "blockquote":
            quote = "\n\n".join(self._plain(one.blocks))
            if quote:
                self._block("\n".join(f"> {line}".rstrip() for line in quote.split("\n")))
        else:  # what is in other blocks counts as the parent's
            for block in one.blocks:
                self._block(block) if isinstance(block, str) else self.open[-1].blocks.append(block)

    @staticmethod
    def _plain(blocks: list) -> list[str]:
        """Blocks as texts; rows and cells outside a table are lines."""
        return [b if isinstance(b, str) else b[1] if b[0] != "tr" else " ".join(b[1]) for b in blocks]

    def _inline(self, one: _Open) -> None:
        raw = "".join([*[f" {b} " for b in self._plain(one.blocks)], *one.text])
        text, parent = raw.strip(f" {_BREAK}"), self.open[-1].text
        if one.tag == "a" and one.attrs.get("href") is not None and text:
            shown = f"[{text}]({one.attrs['href']})"
        elif one.tag in _MARKS and text and not self.names.get("pre"):
            shown = f"{_MARKS[one.tag]}{text}{_MARKS[one.tag]}"
        else:
            parent.append(raw)
            return
        parent += [raw[: len(raw) - len(raw.lstrip(" "))], shown, raw[len(raw.rstrip(" ")) :]]

    def _code(self, one: _Open) -> None:
        text = "".join([*self._plain(one.blocks), *one.text])
        text = text.removeprefix("\n").rstrip("\n")
        longest = max((len(m) for m in re.findall("`{3,}", text)), default=2)
        fence = "`" * (longest + 1)
        if self.names.get("pre"):  # in another one
            self.open[-1].text.append(text)
        elif text:
            self._block(f"{fence}\n{text}\n{fence}")

    def _item(self, one: _Open) -> None:
        lists = self.open[-1]
        lists.count += 1
        mark = f"{lists.count}. " if lists.tag == "ol" else "* "
        text = "\n".join(self._plain(one.blocks)).replace("\n", "\n" + " " * len(mark))
        self._block((mark + text).rstrip())

    def _table(self, one: _Open) -> None:
        rows = [b for b in one.blocks if isinstance(b, tuple) and b[0] == "tr"]
        for other in one.blocks:  # a caption, or text that belongs nowhere
            if isinstance(other, str):
                self._block(other)
        if not rows:
            return
        width = max(len(r[1]) for r in rows)
        cells = [[*r[1], *[""] * (width - len(r[1]))] for r in rows]
        if not rows[0][2]:
            cells.insert(0, [""] * width)
        cells.insert(1, ["---"] * width)
        self._block("\n".join(f"| {' | '.join(row)} |" for row in cells))

    # ------------------------------------------------------------ the page
    def result(self) -> dict:
        while len(self.open) > 1:
            self._close()
        self._end_run()
        markdown = "\n\n".join(self._plain(self.open[0].blocks))
        return {"title": _running(self.titles), "metas": self.metas, "links": self.links, "markdown": markdown, "text": "\n".join(self.lines)}


def read_page(html: str | None) -> dict:
    if html is None:
        return {"title": None, "metas": None, "links": None, "markdown": None, "text": None}
    reader = Reader()
    reader.feed(html.replace("\x00", "�"))
    reader.close()
    return reader.result()


@F.pandas_udf(PAGE)
def page(c: pd.Series) -> pd.DataFrame:
    """A struct of title, metas, links, markdown and text of each page."""
    return pd.DataFrame([read_page(h) for h in c], columns=["title", "metas", "links", "markdown", "text"])
