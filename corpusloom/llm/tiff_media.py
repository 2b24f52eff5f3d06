"""TIFF media columns: texts stored as grey images, and images decoded to one row per page.

The reader walks the image file directories (classic TIFF, both byte orders),
decodes strips or tiles packed with PackBits, LZW or deflate, undoes horizontal
differencing, and gives one row per directory. The writer makes such files.

Defined results: a null media value gives no page; a null or empty text is
stored as one unit of padding. Equal texts give equal files, and repeated or tied
rows need no order; an empty table gives no row. A page is at most
``PAGE_ROWS`` rows high, so a long text becomes several pages and no strip is
longer than ``STRIP_ROWS`` rows, which bounds what one decode step holds.
Extra columns are not read; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._shared import binary, small_batches

UNIT, PAD = 576, 255
STRIP_ROWS, PAGE_ROWS, TILE = 64, 4096, 64

# Values of the TIFF 6.0 specification.
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
_WIDTH, _LENGTH, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS = 256, 257, 258, 259, 262, 273
_SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_LENGTH, _TILE_OFFSETS, _TILE_COUNTS = 322, 323, 324, 325
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4)}
#: Bytes that a byte of packed data can become at most, by the formats: what a directory promises beyond that is broken.
_RATIO = {NONE: 1, PACKBITS: 64, LZW: 2731, DEFLATE: 1032, DEFLATE_OLD: 1032}
#: What a broken file may raise.
_BROKEN = (ValueError, struct.error, zlib.error, LookupError, ArithmeticError, MemoryError, TypeError)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = i + 1
        while run < n and run - i < 128 and data[run] == data[i]:
            run += 1
        if run - i > 1:
            out += bytes([257 - (run - i), data[i]])
            i = run
            continue
        end = i + 1
        while end < n and end - i < 128 and (end + 1 >= n or data[end] != data[end + 1]):
            end += 1
        out.append(end - i - 1)
        out += data[i:end]
        i = end
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        if i >= len(data):
            raise ValueError("PackBits data end early")
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, one code early."""
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    following, width = 258, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    prefix = b""
    for k in range(len(data)):
        longer = prefix + data[k : k + 1]
        if len(longer) == 1 or longer in table:
            prefix = longer
            continue
        put(table[prefix] if len(prefix) > 1 else prefix[0])
        table[longer] = following
        following += 1
        if following == 4094:
            put(256)
            table.clear()
            following, width = 258, 9
        elif following + 1 > 1 << width:
            width += 1
        prefix = data[k : k + 1]
    if prefix:
        put(table[prefix] if len(prefix) > 1 else prefix[0])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, before = list(start), 9, None
    held = bits = at = 0
    while len(out) < size:
        while bits < width:
            if at >= len(data):
                raise ValueError("LZW data end early")
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = list(start), 9, None
            continue
        if before is None:
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(before + entry[:1])
        elif code == len(table):
            entry = before + before[:1]
            table.append(entry)
        else:
            raise ValueError(f"LZW code {code} is not in the table")
        out += entry
        before = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    if len(out) < size:
        raise ValueError("LZW data end early")
    return bytes(out[:size])


def _pack(raw: bytes, compression: int, level: int) -> bytes:
    if compression == NONE:
        return raw
    if compression == PACKBITS:
        return packbits_encode(raw)
    if compression == LZW:
        return lzw_encode(raw)
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.compress(raw, level)
    raise ValueError(f"compression {compression} is not supported")


def _unpack(raw: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = raw[:size]
    elif compression == PACKBITS:
        out = packbits_decode(raw, size)[:size]
    elif compression == LZW:
        out = lzw_decode(raw, size)
    elif compression in (DEFLATE, DEFLATE_OLD):
        inflate = zlib.decompressobj()
        out = inflate.decompress(raw, size)  # never more than the header promises
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(out) != size:
        raise ValueError(f"a strip or tile has {len(out)} bytes instead of {size}")
    return out


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int | None = None, order: str = "<", level: int = 6) -> bytes:
    """A TIFF file of 8- or 16-bit grey pages (2-d arrays), in strips or square tiles."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0"
    link = 4
    for page in pages:
        height, width = page.shape
        kind = page.dtype.newbyteorder(order)
        if tile:
            cells = [np.pad(cell, ((0, tile - cell.shape[0]), (0, tile - cell.shape[1])), mode="edge") for y in range(0, height, tile) for x in range(0, width, tile) for cell in [page[y : y + tile, x : x + tile]]]
        else:
            cells = [page[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        offsets, counts = [], []
        for cell in cells:
            if predictor == 2:
                cell = np.concatenate([cell[:, :1], cell[:, 1:] - cell[:, :-1]], axis=1)
            packed = _pack(cell.astype(kind).tobytes(), compression, level)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        tags = {_WIDTH: [width], _LENGTH: [height], _BITS: [page.dtype.itemsize * 8], _COMPRESSION: [compression], _PHOTOMETRIC: [1], _SAMPLES: [1], _PREDICTOR: [predictor]}
        tags |= {_TILE_WIDTH: [tile], _TILE_LENGTH: [tile], _TILE_OFFSETS: offsets, _TILE_COUNTS: counts} if tile else {_OFFSETS: offsets, _ROWS: [STRIP_ROWS], _COUNTS: counts}
        entries = b""
        for tag in sorted(tags):
            values = struct.pack(f"{order}{len(tags[tag])}I", *tags[tag])
            if len(values) > 4:
                at, out = len(out), out + values
                values = struct.pack(f"{order}I", at)
            entries += struct.pack(f"{order}HHI", tag, 4, len(tags[tag])) + values
        if len(out) % 2:
            out += b"\0"
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    index: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    pixels: np.ndarray


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind not in _SIZES:
            continue
        code, size = _SIZES[kind]
        if size * count > len(data):
            raise ValueError(f"tag {tag} points beyond the file")
        spot = at + 2 + 12 * k + 8
        if size * count > 4:
            (spot,) = struct.unpack_from(f"{order}I", data, spot)
        if spot + size * count > len(data):
            raise ValueError(f"tag {tag} points beyond the file")
        tags[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, spot) if kind != 2 else (data[spot : spot + count],)
    (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    return tags, following


def _one(tags: dict[int, tuple], tag: int, default: int | None = None) -> int:
    if tag not in tags and default is None:
        raise ValueError(f"tag {tag} is missing")
    return tags[tag][0] if tags.get(tag) else default


def decode(data: bytes, errors: bool = False) -> Iterator[Page | tuple[int, str]]:
    """The pages of a TIFF file, in the order of its directories.

    With ``errors``, a page that can't be decoded is (its number, what is wrong)
    and the next one follows; else it raises.
    """
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:  # a file has as many directories as it has places for them
            raise ValueError("the directories form a loop")
        seen.add(at)
        tags, following = _directory(data, at, order)
        try:
            yield _page(data, tags, order, len(seen) - 1)
        except _BROKEN as e:
            if not errors:
                raise
            yield len(seen) - 1, f"{type(e).__name__}: {e}"
        at = following


def _samples(raw: bytes, kind: np.dtype, bits: int, rows: int, wide: int, samples: int) -> np.ndarray:
    """Rows of samples; those of less than 8 bits are unpacked, each row from a byte of its own on."""
    if bits >= 8:
        return np.frombuffer(raw, dtype=kind).reshape(rows, wide, samples)
    one = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : wide * samples * bits]
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    return (one.reshape(rows, wide, samples, bits) * weights).sum(axis=3, dtype=np.uint8)


def _page(data: bytes, tags: dict[int, tuple], order: str, index: int) -> Page:
    width, height = _one(tags, _WIDTH), _one(tags, _LENGTH)
    samples, compression, predictor, planes = _one(tags, _SAMPLES, 1), _one(tags, _COMPRESSION, NONE), _one(tags, _PREDICTOR, 1), _one(tags, _PLANAR, 1)
    found = set(tags.get(_BITS, (1,)))
    bits = found.pop()
    if found or bits not in (1, 2, 4, 8, 16, 32) or planes not in (1, 2) or predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise ValueError(f"bits {bits}, planes {planes} or predictor {predictor} are not supported")
    if compression not in _RATIO:
        raise ValueError(f"compression {compression} is not supported")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    tiled = _TILE_OFFSETS in tags
    high, wide = (_one(tags, _TILE_LENGTH), _one(tags, _TILE_WIDTH)) if tiled else (min(_one(tags, _ROWS, height), height), width)
    if min(width, height, samples, high, wide) < 1:
        raise ValueError("a width, height or number of samples is 0")
    offsets, counts = (tags[_TILE_OFFSETS], tags[_TILE_COUNTS]) if tiled else (tags[_OFFSETS], tags[_COUNTS])
    across, down, layers = -(-width // wide), -(-height // high), samples if planes == 2 else 1
    if len(offsets) != across * down * layers or len(counts) != len(offsets):
        raise ValueError("the number of strips or tiles does not fit the size")
    each = samples // layers
    line = -(-wide * each * bits // 8)
    if (down if tiled else height / high) * high * line * across * layers > _RATIO[compression] * (sum(counts) + 16 * len(counts)):
        raise ValueError("the directory promises more than its bytes can hold")
    if any(at + n > len(data) for at, n in zip(offsets, counts, strict=True)):
        raise ValueError("a strip or tile lies beyond the file")
    pixels = np.empty((height, width, samples), dtype=kind.newbyteorder("="))
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        layer, cell_no = divmod(k, across * down)
        y, x = cell_no // across * high, cell_no % across * wide
        rows = high if tiled else min(high, height - y)
        if rows * line > _RATIO[compression] * (n + 16):
            raise ValueError("a strip or tile promises more than its bytes can hold")
        cell = _samples(_unpack(data[at : at + n], compression, rows * line), kind, bits, rows, wide, each).astype(pixels.dtype)
        if predictor == 2:
            cell = np.cumsum(cell, axis=1, dtype=pixels.dtype)
        part = pixels[y : y + rows, x : x + wide]
        part[:, :, layer * each : (layer + 1) * each] = cell[: height - y, : width - x]
    return Page(index, width, height, bits, samples, compression, predictor, pixels)


def payload(text: bytes | None, unit: int = UNIT) -> bytes:
    """The text's bytes, padded to a positive multiple of ``unit``."""
    text = text or b""
    return text + bytes([PAD]) * ((-len(text)) % unit if text else unit)


def store(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` as a TIFF file. Its form goes by its checksum: of 16, one each has LZW strips, PackBits strips, big-endian deflate tiles; the rest has deflate strips with differencing."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, unit)
    images = [rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)]
    form = zlib.crc32(data) % 16
    if form == 0:
        return encode(images, LZW)
    if form == 1:
        return encode(images, PACKBITS)
    if form == 2:
        return encode(images, DEFLATE, tile=TILE, order=">", level=3)
    return encode(images, DEFLATE, predictor=2, level=3)


def to_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and the column ``media``: each text as a TIFF file. No shuffle."""
    small_batches(df.sparkSession)
    schema = f"{key} {dict(df.dtypes)[key]}, n_bytes long, media binary"

    def run(batches):
        for batch in batches:
            texts = binary(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([store(payload(t)) for t in texts], pa.binary())], names=[key, "n_bytes", "media"])

    return df.select(key, text).mapInArrow(run, schema)


def pages(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per page of each file in the column ``media``; a page that is broken or not supported, or where the chain of directories breaks, gives a row with ``error`` set."""
    small_batches(df.sparkSession)
    schema = f"{key} {dict(df.dtypes)[key]}, page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, error string"

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0), binary(batch.column(1)), strict=True):
                rows = []
                try:
                    for p in decode(data, errors=True) if data is not None else []:
                        rows.append((p[0], *[None] * 7, p[1]) if isinstance(p, tuple) else (p.index, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.pixels.tobytes(), None))
                except _BROKEN as e:
                    rows.append((len(rows), *[None] * 7, f"{type(e).__name__}: {e}"))
                kinds = [*[pa.int32()] * 7, pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), batch.column(0).type), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)]], names=[key, "page", "width", "height", "bits", "samples", "compression", "predictor", "pixels", "error"])

    return df.select(key, media).mapInArrow(run, schema)


def features(df: DataFrame) -> DataFrame:
    """What is read back from the column ``media`` of :func:`to_media`: digests and an image feature of each file."""
    small_batches(df.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [f.split()[0] for f in schema.split(", ")]

    def of(media: bytes) -> tuple:
        digest, total, hist, n, tail = hashlib.sha256(), 0, np.zeros(256, dtype=np.int64), 0, b""
        width = 0
        for page in decode(media):
            raw = page.pixels.tobytes()
            digest.update(raw)
            total, n, tail, width = total + len(raw), n + 1, (tail + raw)[-32:], page.width
            hist += np.bincount(page.pixels.ravel(), minlength=256)
        share = hist[hist > 0] / max(total, 1)
        mean = float((hist * np.arange(256)).sum()) / max(total, 1)
        feature = f"{width}x{total // max(width, 1)};pages={n};mean={mean:.3f};entropy={-(share * np.log2(share)).sum():.3f}"
        return total, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        for batch in batches:
            rows = [of(m) for m in binary(batch.column(2))]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]], names=names)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return features(to_media(documents))
