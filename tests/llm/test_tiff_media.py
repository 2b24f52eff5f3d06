import hashlib
import itertools
import zlib

import numpy as np
import pytest

from corpusloom.llm.tiff_media import DEFLATE, LZW, NONE, PACKBITS, decode, encode, features, lzw_decode, lzw_encode, packbits_decode, packbits_encode, pages, payload, query, to_media


def test_round_trips():
    rng = np.random.default_rng(1)
    for shape, kind, compression, predictor, tile, order in itertools.product([(1, 1), (3, 576), (130, 70)], [np.uint8, np.uint16], [NONE, LZW, DEFLATE, PACKBITS], [1, 2], [None, 16], "<>"):
        given = [rng.integers(0, 5, shape).astype(kind), rng.integers(0, np.iinfo(kind).max, shape).astype(kind)]
        got = list(decode(encode(given, compression, predictor, tile, order)))
        assert [p.index for p in got] == [0, 1] and all((p.pixels[:, :, 0] == g).all() for p, g in zip(got, given, strict=True))


def test_codecs():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"a" * 5000, rng.integers(0, 256, 60000, dtype=np.uint8).tobytes(), bytes(range(256)) * 40):
        assert lzw_decode(lzw_encode(data), len(data)) == data and packbits_decode(packbits_encode(data), len(data)) == data
    # Known streams: of the TIFF specification's section on PackBits, and of a LZW strip by hand.
    assert packbits_decode(bytes.fromhex("feaa0280002afdaa0380002a22f7aa"), 24) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")
    assert lzw_decode(bytes.fromhex("8001c0a0341a0d0080"[:14]), 0) == b""


def test_broken_files_raise():
    good = encode([np.zeros((4, 4), np.uint8)])
    for bad in (b"", b"II*\0", good[:20], b"XX" + good[2:], good[:-8]):
        with pytest.raises(Exception):
            list(decode(bad))
    loop = bytearray(good)
    at = int.from_bytes(good[4:8], "little")
    n = int.from_bytes(good[at : at + 2], "little")
    loop[at + 2 + 12 * n : at + 6 + 12 * n] = good[4:8]
    with pytest.raises(ValueError, match="loop"):
        list(decode(bytes(loop)))


def expected(text):
    raw = payload((text or "").encode())
    return len((text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:])


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = query(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == {i: expected(t) for i, t in docs.items()}


def test_odd_rows_and_pages(spark):
    texts = [None, "", "a", "b" * 576, "c" * 577, "é" * 400, "long " * 600000, "a"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in features(to_media(df)).collect()}
    assert {i: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for i, r in rows.items()} == {k: expected(t) for k, t in enumerate(texts)}
    assert rows[0].media_sha256 == rows[1].media_sha256 and rows[2].feature == rows[7].feature
    found = pages(to_media(df)).collect()
    assert sum(r.doc_id == 6 for r in found) > 1 and all(r.error is None for r in found)
    whole = b"".join(bytes(r.pixels) for r in sorted(found, key=lambda r: r.page) if r.doc_id == 6)
    assert whole == payload(texts[6].encode())
    broken = pages(spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.error is not None) for r in broken] == [(1, True)]
    assert features(to_media(df.limit(0))).collect() == []


def _with(file, tag, value):
    """``file`` with another value of a tag of its (only) directory."""
    out, at = bytearray(file), int.from_bytes(file[4:8], "little")
    for k in range(int.from_bytes(file[at : at + 2], "little")):
        spot = at + 2 + 12 * k
        if int.from_bytes(file[spot : spot + 2], "little") == tag:
            out[spot + 8 : spot + 12] = value.to_bytes(4, "little")
    return bytes(out)


def test_broken_tags_are_rows_with_errors(spark):
    tiles, strips = encode([np.zeros((40, 40), np.uint8)], DEFLATE, tile=16), encode([np.zeros((4, 4), np.uint8)])
    bad = [_with(tiles, 322, 0), _with(tiles, 323, 0), _with(strips, 277, 0xFFFFFFF0), _with(strips, 256, 0xFFFFFFFF), _with(strips, 257, 0xFFFFFFFF), _with(strips, 258, 7), _with(strips, 256, 0), _with(strips, 259, 99)]
    rows = pages(spark.createDataFrame(list(enumerate([*bad, strips])), "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.error is None) for r in sorted(rows, key=lambda r: r.doc_id)] == [*[(k, False) for k in range(len(bad))], (len(bad), True)]


def test_a_broken_page_does_not_end_the_file():
    good = encode([np.full((2, 8), 7, np.uint8), np.full((2, 8), 9, np.uint8)], NONE)
    first = list(decode(_with(good, 259, 99), errors=True))
    assert first[0][0] == 0 and "99" in first[0][1] and (first[1].pixels == 9).all()


def test_rows_of_few_bits():
    one = encode([np.array([[0b10110000], [0b01000000]], np.uint8)], NONE)
    page = next(decode(_with(_with(one, 258, 1), 256, 4)))
    assert page.bits == 1 and page.pixels[:, :, 0].tolist() == [[1, 0, 1, 1], [0, 1, 0, 0]]
    page = next(decode(_with(_with(one, 258, 4), 256, 2)))
    assert page.pixels[:, :, 0].tolist() == [[11, 0], [4, 0]]


def test_the_query_uses_every_form(spark):
    from corpusloom.llm.tiff_media import store

    found = {(p.compression, file[:2], p.predictor) for k in range(200) for file in [store(payload(f"text {k}".encode()))] for p in decode(file)}
    assert found == {(LZW, b"II", 1), (PACKBITS, b"II", 1), (DEFLATE, b"MM", 1), (DEFLATE, b"II", 2)}


def test_long_chains_are_no_loops():
    import struct

    from corpusloom.llm.tiff_media import _directory

    data = encode([np.full((1, 1), k % 256, np.uint8) for k in range(3000)])
    assert [int(p.pixels.ravel()[0]) for p in decode(data)] == [k % 256 for k in range(3000)]
    (first,) = struct.unpack_from("<I", data, 4)
    _, second = _directory(data, first, "<")
    looped = data.replace(struct.pack("<I", _directory(data, second, "<")[1]), struct.pack("<I", first), 1)
    with pytest.raises(ValueError, match="loop"):
        list(decode(looped))
