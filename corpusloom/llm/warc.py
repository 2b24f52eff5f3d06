"""WARC archives compressed with Zstandard, one frame for each record.

An archive starts with a skippable frame that holds the dictionary its records
were compressed with; every record is a frame of its own. The reader loads the
dictionary, decodes one frame at a time, and checks the version line, the
required fields, the lengths and the payload digest.

Defined results: a null payload is an empty one; rows with a null id are
written and read with a null id and count as lower than all others; of rows
that share the largest id of a payload each is a response, and repeated rows are
records each; an empty table gives no archive and no row; a very long payload is
one record, held whole by one task, up to MAX_RECORD bytes. Skippable frames
after the first are passed over. Extra columns, of whatever names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._shared import attempt_name, binary, filesystem, saved, shared_dir, small_batches, write_file

#: Magic number of the skippable frame that holds a dictionary, and of Zstandard's own frames (fixed values).
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Payload bytes from which a repeated payload becomes a revisit record.
REVISIT_BYTES = 0
#: The dictionary is trained on this many records at the start of an archive, so many bytes of each.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 4096, 16 << 10
#: Uncompressed payload bytes after which a task starts its next archive.
ARCHIVE_BYTES = 256 << 20
#: A record longer than this is refused, on writing and on reading.
MAX_RECORD = 1 << 31
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def _id(field: str) -> int | None:
    value = field.strip("<>").removeprefix("urn:page:")
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response or revisit record; a revisit has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = (url or "").encode("unicode_escape").decode().replace(" ", "%20")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_urn(page_id)}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", target or "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_urn(refers_to)}>")]
    whole = _VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    if len(whole) > MAX_RECORD:  # it could not be read back
        raise WarcError(f"the record of page {page_id} is too long: {len(whole)} bytes")
    return whole


def _trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # samples too short or too alike
        return None


def archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """The archive's bytes: the dictionary's frame, then a frame for each record."""
    first = []
    for one in records:
        first.append(one)
        if len(first) == SAMPLES:
            break
    trained = _trained([r[:SAMPLE_BYTES] for r in first])
    raw = trained.as_bytes() if trained else b""
    packed = zstandard.compress(raw) if raw else b""
    yield struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
    pack = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True)
    for one in first:
        yield pack.compress(one)
    for one in records:
        yield pack.compress(one)


class WarcError(ValueError):
    """The archive is not what its heads promise."""


def frames(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decoded records of an archive, one frame at a time."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as file:
        head = file.read(8)
        magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        if magic != DICTIONARY_MAGIC:
            raise WarcError(f"{uri} does not start with a dictionary frame")
        raw = file.read(size)
        if len(raw) != size:
            raise WarcError(f"{uri}: the dictionary frame ends early")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.decompress(raw)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        held = b""
        while held := held or file.read(chunk):
            one, parts, size = unpack.decompressobj(), [], 0
            while True:
                parts.append(one.decompress(held))
                size += len(parts[-1])
                if size > MAX_RECORD:
                    raise WarcError(f"{uri}: a record is too long")
                if one.eof:
                    held = one.unused_data
                    break
                if not (held := file.read(chunk)):
                    raise WarcError(f"{uri}: the last frame ends early")
            if size:  # a skippable frame between records has no content
                yield b"".join(parts)


def _fields(raw: bytes, what: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not gap or not first.startswith(what):
        raise WarcError(f"a record's head is broken: {raw[:40]!r}")
    fields = {}
    for line in lines.decode().split("\r\n") if lines else []:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a field: {line!r}")
        fields[name.strip().lower()] = value.strip()
    return fields, rest


def parse(raw: bytes) -> dict:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type and refers_to of a record, checked."""
    fields, rest = _fields(raw, _VERSION)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields)
    if missing:
        raise WarcError(f"fields are missing: {sorted(missing)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, the block has {len(rest) - 4}")
    http, payload = _fields(rest[:length], b"HTTP/")
    promised, kind = int(http["content-length"]), fields["warc-type"]
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != promised or digest(payload) != named:
            raise WarcError("a payload has not the length or digest that its head names")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise WarcError(f"not a response or a whole revisit: {kind}")
    return {
        "page_id": _id(fields["warc-record-id"]), "payload_bytes": promised, "payload_digest": named, "record_type": kind,
        "refers_to": _id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None,
    }


def resolve(pages: DataFrame, key: str, payload: str, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with the column ``refers_to``: the id of the response that a repeated payload revisits, else null.

    The largest id of each payload is found from digests alone; only payloads
    that occur more than once meet the pages in a join, which Spark splits
    where one payload has very many rows.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    # Payloads too short to be revisited get keys of their own, which the other side lacks.
    rows = pages.withColumn("_digest", F.when(F.octet_length(body) >= least, F.sha1(F.encode(body, "utf-8"))).otherwise(F.concat(F.lit("#"), F.xxhash64(key, body).cast("string"))))
    tops = rows.where("NOT startswith(_digest, '#')").groupBy("_digest").agg(F.count("*").alias("_n"), F.max(key).alias("_top")).where("_n > 1").drop("_n")
    joined = rows.join(tops, "_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col(key).eqNullSafe(F.col("_top")), F.col("_top"))).drop("_digest", "_top")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row into archives below ``folder``; the saved table of the archives."""
    small_batches(pages.sparkSession)
    rows = resolve(pages.select(key, url, payload), key, payload, least).select(F.col(key).cast("long"), url, payload, F.col("refers_to").cast("long"))

    def run(batches):
        part = TaskContext.get().partitionId()

        def records():
            for batch in batches:
                ids, urls, bodies, tops = (batch.column(k) for k in range(4))
                for i, u, body, top in zip(ids.to_pylist(), urls.to_pylist(), binary(bodies), tops.to_pylist(), strict=True):
                    yield record(i, u, body or b"", top, top is not None)

        source = records()
        for one in source:
            counted = [1, len(one)]

            def run_of(first=one, counted=counted):
                yield first
                while counted[1] < archive_bytes:
                    if (following := next(source, None)) is None:
                        return
                    counted[0], counted[1] = counted[0] + 1, counted[1] + len(following)
                    yield following

            uri = f"{folder}/{attempt_name(part)}.warc.zst"
            size = write_file(uri, archive(run_of()))
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([counted[0]], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

    return saved(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row for each record of the archives that the column ``path`` names (with url and payload, if asked for)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 7 if payloads else 5]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                for raw in frames(uri):
                    one = parse(raw)
                    rows.append([one[n] for n in names])
                    size += len(raw) if payloads else 1
                    if len(rows) == 1024 or size > 8 << 20:
                        yield _batch(rows, kinds, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, kinds, names)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(run, schema)


def _batch(rows: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, shared_dir(spark, "warc")))
