"""Token counts, with very long texts encoded in overlapping chunks that are spliced where they agree.

A text of up to ``CHUNK`` characters is encoded whole. Of a longer one, chunks
that overlap by ``OVERLAP`` characters are encoded with offsets, one after
another, and two neighbours are spliced at a boundary between pre-tokens that
both have. That such a boundary is one of the whole text, and that the right
chunk is right from there on, follows by induction:

* The pre-tokenizer scans from left to right, and a match depends only on the
  characters from its start on. Where a scan of the right chunk reaches a start
  of a pre-token of the whole text, both go on alike; and merges never cross
  pre-tokens, so the tokens are alike, too.
* In the left chunk, which is right from its own splice on, a pre-token that
  ends before the chunk's end was found with all it depends on, unless a special
  string is cut by that end. So boundaries nearer to the end than the longest
  special string (and two characters more) are not used. A special string over
  the boundary would lie whole in the left chunk, which would not have the
  boundary then.

Where the chunks share no such boundary, for instance within one very long word,
the overlap is widened by doubling, so the work stays proportional to the text.
Tokenizers of other rules (a normalizer, another pre-tokenizer, a prefix space,
special strings that take in spaces) get whole texts.

Defined results: a null or empty text has no bytes and no tokens; repeated rows
are counted each, whatever their ids; null ids are kept; an empty table gives no
row; of a very long text one chunk's encoding is held at a time. Other columns
pass through :func:`count_tokens`; a column of the caller's with a name of ours
gives way.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm._shared import read_table, small_batches

LIMIT = 1024
#: Characters of a chunk and of two chunks' overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Characters of the short texts that are encoded in one call.
CALL_CHARS = 1 << 18


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def splice_margin(rules: dict) -> int | None:
    """How far from a chunk's end a boundary must be, or None if the tokenizer's rules prove no boundary."""
    before, model = rules.get("pre_tokenizer") or {}, rules.get("model") or {}
    added = rules.get("added_tokens") or []
    memoryless = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    plain = rules.get("normalizer") is None and rules.get("post_processor") is None and model.get("type") == "BPE" and not model.get("dropout")
    exact = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return max([len(t["content"]) for t in added], default=0) + 2 if memoryless and plain and exact else None


class Spliced:
    """A tokenizer that takes long texts in chunks."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            raw = file.read()
        self.tokenizer = Tokenizer.from_str(raw)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.margin = splice_margin(json.loads(raw))
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0  #: overlaps that had to be widened so far

    def _encoded(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of text[start:end], and of its pre-tokens the places in the text and the first tokens."""
        found = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        words = np.array(found.word_ids, dtype=np.int64)
        offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        first = np.flatnonzero(np.diff(words, prepend=-1) != 0)
        # Only where one ends and the next begins, with nothing between them.
        whole = np.array([k == 0 or offsets[k - 1, 1] == offsets[k, 0] for k in first], dtype=bool)
        first = first[whole]
        return np.array(found.ids, dtype=np.uint32), offsets[first, 0] + start, first

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """The text's ids, a piece at a time."""
        n = len(text)
        if self.margin is None or n <= self.chunk:
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            return
        origin, end = 0, self.chunk  # the left chunk is right from ``origin`` on
        left = self._encoded(text, origin, end)
        done, width = 0, self.overlap  # tokens of the left chunk that are given already
        while end < n:
            start, until = max(origin, end - width), min(n, end + max(self.chunk, width))
            right = self._encoded(text, start, until)
            both, a, b = np.intersect1d(left[1], right[1], assume_unique=True, return_indices=True)
            fit = np.flatnonzero((both <= end - self.margin) & (both >= origin))
            if not len(fit):
                self.widened += 1
                width *= 2
                end = min(n, end + width)
                left, done = self._encoded(text, origin, end), 0
                continue
            at = fit[-1]
            yield left[0][done : left[2][a[at]]]
            origin, end, left, done, width = int(both[at]), until, right, int(right[2][b[at]]), self.overlap if both[at] > origin else width * 2
        yield left[0][done:]

    def count(self, text: str) -> int:
        return sum(len(x) for x in self.pieces(text))

    def counts(self, texts: list[str]) -> list[int]:
        """Of each text the number of its tokens; short ones are encoded together."""
        out, held, size = [0] * len(texts), [], 0

        def flush():
            for k, found in zip(held, self.tokenizer.encode_batch_fast([texts[k] for k in held], add_special_tokens=False), strict=True):
                out[k] = len(found)
            held.clear()

        for k, text in enumerate(texts):
            if len(text) > self.chunk and self.margin is not None:
                out[k] = self.count(text)
                continue
            held.append(k)
            size += len(text)
            if size >= CALL_CHARS:
                flush()
                size = 0
        flush()
        return out


_open: dict[tuple, Spliced] = {}


def opened(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Spliced:
    """The tokenizer, read once by a worker process."""
    key = (path, chunk, overlap)
    if key not in _open:
        _open.clear()
        _open[key] = Spliced(*key)
    return _open[key]


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``n_tokens``; no shuffle. ``path``: the tokenizer's file, which every executor can read."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    names = [c for c in docs.columns if c != "n_tokens"]
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("n_tokens"))
    kind, place = to_arrow_schema(out.schema), names.index(text)

    def run(batches):
        tokenizer = opened(path, chunk, overlap)
        for batch in batches:
            counts = tokenizer.counts([t or "" for t in batch.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64())], names=kind.names)

    return out.mapInArrow(run, out.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
