"""URL rules looked up in a sorted digest array.

A rule is (host, path, allow). It fits its host and all subdomains of it when
the url's path starts with the rule's path; of several the longest wins (of
equally long ones the longer host). Every (host suffix, path prefix) that could
be a rule is hashed with 64-bit xxhash and looked up in a memory-mapped sorted
array of the rules' digests by a vectorised binary search; the stored string
must then equal the probe, so a collision of digests decides nothing.

Defined results: a null url, an empty one or one without ``://`` has empty host
and path, no rule, and the default verdict; very long urls are judged whole, an
empty table gives no row, and without rules all have the default verdict. Extra
columns pass through; a clash with one of the output names (or with
``rule_host_bytes``) is the caller's column dropped. Repeated rows stay.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._shared import saved

#: The index is broadcast; a rule set beyond this many bytes is refused by :func:`apply_rules` in one piece and split by it.
MAX_INDEX_BYTES = 256 << 20
_HEAD = struct.Struct("<8sQQQQ")
_MAGIC = b"URLDIG02"
#: Indexes that a worker process keeps mapped.
_MAPPED = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` (starting with ``/``) and what a fitting url gets."""

    host: str
    path: str
    allow: bool

    @property
    def key(self) -> str:
        return f"{self.host}{self.path}"


def _key(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode("utf-8", "surrogatepass")


def build_index(rules: Iterable[Rule]) -> bytes:
    """Head, sorted digests, offsets of the strings, path lengths, strings, verdicts. The last of equal rules counts."""
    last = {_key(r.host, r.path): r.allow for r in rules}
    order = sorted((xxhash.xxh64_intdigest(k), k) for k in last)
    strings = b"".join(k for _, k in order)
    offsets = np.cumsum([0, *[len(k) for _, k in order]], dtype=np.uint64)
    digests = np.array([d for d, _ in order], dtype=np.uint64)
    verdicts = np.array([last[k] for _, k in order], dtype=np.uint8)
    # Only lengths that rules have need be tried.
    lengths = np.unique(np.array([len(k) - k.index(b"\0") - 1 for k in last], dtype=np.uint64))
    labels = max((k[: k.index(b"\0")].count(b".") + 1 for k in last), default=0)
    return b"".join([_HEAD.pack(_MAGIC, len(order), len(strings), len(lengths), labels), digests.tobytes(), offsets.tobytes(), lengths.tobytes(), strings, verdicts.tobytes()])


class DigestIndex:
    """A rule index, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        magic, n, size, lengths, self.most_labels = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        if magic != _MAGIC or len(raw) != _HEAD.size + 8 * n + 8 * (n + 1) + 8 * lengths + size + n:
            raise ValueError(f"{path} is no rule index")
        at = _HEAD.size
        self.digests = raw[at : at + 8 * n].view(np.uint64)
        self.offsets = raw[at + 8 * n : at + 16 * n + 8].view(np.uint64)
        at += 16 * n + 8
        self.path_sizes = raw[at : at + 8 * lengths].view(np.uint64).tolist()
        at += 8 * lengths
        self.strings, self.verdicts = raw[at : at + size], raw[at + size :]  # stay in the map

    def string(self, i: int) -> bytes:
        return self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The position of each probe among the rules, -1 if it is none."""
        found = np.full(len(probes), -1, dtype=np.int64)
        if not len(self.digests) or not probes:
            return found
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, probes), dtype=np.uint64, count=len(probes))
        at = np.searchsorted(self.digests, hashes)
        todo = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == hashes))
        for k in todo:
            i = int(at[k])
            while i < len(self.digests) and self.digests[i] == hashes[k]:  # collisions stand side by side
                if self.string(i) == probes[k]:
                    found[k] = i
                    break
                i += 1
        return found


_open: dict[bytes, DigestIndex] = {}


def _mapped(index: bytes) -> DigestIndex:
    """The index as a file of this worker's own, written once."""
    name = xxhash.xxh128_digest(index)
    if name not in _open:
        fd, path = tempfile.mkstemp(suffix=".urldig")
        with os.fdopen(fd, "wb") as out:
            out.write(index)
        while len(_open) >= _MAPPED:
            del _open[next(iter(_open))]
        _open[name] = DigestIndex(path)
        os.unlink(path)  # stays mapped
    return _open[name]


def _judge(index: DigestIndex, hosts: list[str], paths: list[str], default: str) -> tuple[list[str | None], list[str], list[int]]:
    """The longest rule of each url, its verdict, and the bytes of its host."""
    probes: dict[bytes, int] = {}
    rows: list[list[tuple[int, int, int]]] = []
    for host, path in zip(hosts, paths, strict=True):
        own, raw = [], path.encode("utf-8", "surrogatepass")
        labels = host.split(".")
        for k in range(max(0, len(labels) - index.most_labels), len(labels)):
            suffix = ".".join(labels[k:])
            stem = _key(suffix, "")
            for size in index.path_sizes:
                if size <= len(raw):
                    own.append((len(stem) + size, len(stem) - 1, probes.setdefault(stem + raw[:size], len(probes))))
        rows.append(own)
    found = index.find(list(probes))
    rules: list[str | None] = []
    verdicts: list[str] = []
    sizes: list[int] = []
    for own in rows:
        best = max(((a, b, found[c]) for a, b, c in own if found[c] >= 0), default=None)
        rules.append(None if best is None else index.string(best[2]).replace(b"\0", b"", 1).decode("utf-8", "surrogatepass"))
        verdicts.append(default if best is None else "allow" if index.verdicts[best[2]] else "block")
        sizes.append(0 if best is None else best[1])
    return rules, verdicts, sizes


def host_and_path(url: str) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url column, JVM-side."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def apply_rules(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``df`` without its url, with host, path, rule and verdict; no shuffle.

    The rules are given by the caller, not read from the corpus; an index of
    more than ``max_index_bytes`` is split, and the url table passes each part;
    what wins does not depend on the split.
    """
    size = sum(len(r.host.encode()) + len(r.path.encode()) + 18 for r in rules)
    host, path = host_and_path(url)
    keep = [c for c in df.columns if c not in (url, "host", "path", "rule", "verdict", "rule_host_bytes")]
    out = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).cast("long").alias("rule_host_bytes"))
    parts = max(1, -(-size // max_index_bytes))
    # Equal rules fall into one part, so that the last of them counts.
    dealt: list[list[Rule]] = [[] for _ in range(parts)]
    for r in rules:
        dealt[xxhash.xxh64_intdigest(_key(r.host, r.path)) % parts].append(r)
    dealt = [part for part in dealt if part] or [[]]
    for k, part in enumerate(dealt, 1):
        shared = df.sparkSession.sparkContext.broadcast(build_index(part))
        out = _probe(out, shared, default)
        if k < len(dealt):  # one part at a time is sent out, and one worker a task is at work
            out = saved(out, "judged")
            shared.destroy()
    return out.drop("rule_host_bytes")


def _probe(df: DataFrame, shared, default: str) -> DataFrame:
    names = df.columns

    def run(batches):
        own = _mapped(shared.value)
        for batch in batches:
            rules, verdicts, sizes = _judge(own, batch.column("host").to_pylist(), batch.column("path").to_pylist(), default)
            before = zip(*(batch.column(c).to_pylist() for c in ("rule", "verdict", "rule_host_bytes")), strict=True)
            for k, (rule, verdict, size) in enumerate(before):  # of an earlier part of the rules
                if rule is not None and (rules[k] is None or (len(rule.encode()), size) > (len(rules[k].encode()), sizes[k])):
                    rules[k], verdicts[k], sizes[k] = rule, verdict, size
            columns = {c: batch.column(c) for c in names} | {"rule": pa.array(rules, pa.string()), "verdict": pa.array(verdicts, pa.string()), "rule_host_bytes": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return df.mapInArrow(run, df.schema)


#: The rules of the registered query (fixed values).
RULES = [
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return apply_rules(pages, RULES)


SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
  FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1
"""
