import base64
import hashlib
import struct

import pytest
import zstandard

from corpusloom.llm.warc import DICTIONARY_MAGIC, WarcError, archive, frames, parse, query, read_archives, record, write_archives


def expected(rows):
    top = {}
    for i, html in rows:
        key = html or ""
        top[key] = max([x for x in (top.get(key), i) if x is not None], default=None)
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        head = top[html or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == head else "revisit", None if i == head else head))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    assert rows(query(spark, sf)) == expected([tuple(r) for r in pages])


def test_odd_rows(spark, tmp_path):
    given = [(1, "a"), (2, "a"), (5, "a"), (3, None), (4, ""), (None, "a"), (None, "only"), (7, "é" * 300000), (8, "x\r\n\r\ny"), (8, "x\r\n\r\ny")]
    df = spark.createDataFrame([(i, h, "http://u v", "x", 1) for i, h in given], "page_id long, html string, url string, refers_to string, _digest int")
    archives = write_archives(df, str(tmp_path), archive_bytes=1000)
    assert all(open(r.path, "rb").read(4) == struct.pack("<I", DICTIONARY_MAGIC) for r in archives.collect())
    assert rows(read_archives(archives)) == expected(given)
    assert read_archives(write_archives(df.limit(0), str(tmp_path))).collect() == []
    whole = {r.page_id: r.payload for r in read_archives(archives, payloads=True).collect() if r.record_type == "response"}
    assert bytes(whole[7]).decode() == "é" * 300000
    long = write_archives(df, str(tmp_path), least=2)
    assert {r.page_id for r in read_archives(long).where("record_type = 'revisit'").collect()} == set()


def test_dictionary_and_frames(tmp_path):
    path = tmp_path / "a.warc.zst"
    given = [record(k, "http://a/", f"<html>{k} the same page again and again {k * 7}</html>".encode() * 9) for k in range(400)]
    path.write_bytes(b"".join(archive(iter(given))))
    raw = path.read_bytes()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == DICTIONARY_MAGIC and size > 0
    assert list(frames(str(path), chunk=777)) == given
    with pytest.raises(zstandard.ZstdError):  # the records need the dictionary
        zstandard.ZstdDecompressor().decompressobj().decompress(raw[8 + size :])
    for cut in (4, 8 + size // 2, len(raw) - 3):
        path.write_bytes(raw[:cut])
        with pytest.raises((WarcError, zstandard.ZstdError)):
            list(frames(str(path)))


def test_records_are_checked():
    good = record(1, "http://a/", b"payload")
    assert parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"payload", b"payloax"), good.replace(b"WARC-Date", b"WARC-Dat3"), good.replace(b"WARC-Type: response", b"WARC-Type: other")):
        with pytest.raises(WarcError):
            parse(bad)


def test_a_record_that_could_not_be_read_is_not_written(monkeypatch):
    from corpusloom.llm import warc

    monkeypatch.setattr(warc, "MAX_RECORD", 1000)
    assert parse(record(1, "http://a/", b"x" * 300))
    with pytest.raises(WarcError, match="too long"):
        record(1, "http://a/", b"x" * 1000)
