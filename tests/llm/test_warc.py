import base64
import hashlib
import io
import os
import zipfile
import zlib
from pathlib import Path

import pytest

from textloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def expected(rows):
    first = {}
    for p, _, html in rows:
        if p is not None:
            first[html or ""] = min(first.get(html or "", p), p)
    out = []
    for p, _, html in rows:
        data, f = (html or "").encode(), first.get(html or "")
        again = f is not None and f != p
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/1", "<p>é 漢</p>"), (2, "http://a/2", "<p>é 漢</p>"), (3, None, None), (4, "http://a\r\nX: y", ""), (5, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n"),
    (5, "u", "other"), (2, "http://a/2", "<p>é 漢</p>"), (None, "n", "<p>é 漢</p>"), (None, "n", "only here"), (None, None, "only here"), (-9, "n", "long " * 200_000), (10, "v", "long " * 200_000),
]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' AS digest", "'y' AS size", "'z' AS first", "1 AS n")
    assert found(warc.archive_round_trip(df)) == expected(ROWS)
    assert {(r["page_id"], r["url"]) for r in warc.archive_round_trip(df).filter("page_id in (1, 3, 4)").collect()} == {(1, "http://a/1"), (3, None), (4, "http://a%0D%0AX: y")}
    assert found(warc.archive_round_trip(spark.createDataFrame([], SCHEMA))) == []


def test_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [*ROWS, *((k, "u", "hot") for k in range(100, 400)), *((k, "u", f"pair {k // 2}") for k in range(500, 560))]
    assert found(warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def package(tmp_path, pages, comment=b"", front=b"") -> str:
    """A package by Package, then with bytes in front and a comment."""
    p = warc.Package(str(tmp_path))
    for k, html in enumerate(pages):
        p.add(k, warc.warc_record(k, "u", html, warc.payload_digest(html), None))
    path, n, _ = p.close()
    assert n == len(pages)
    if comment or front:
        with zipfile.ZipFile(path, "a") as z:
            z.comment = comment
        data = front + Path(path).read_bytes()
        Path(path).write_bytes(data)
    return path


PAGES = [b"one", b"", b"three " * 9000, "vier é".encode()]


def payloads(path):
    return [r["payload"] for block in warc.package_blocks(path) for r in warc.read_block(*block)]


@pytest.mark.parametrize("comment", [b"", b"a note", b"PK\x05\x06" + bytes(18) + b"tail"])
@pytest.mark.parametrize("front", [b"", b"#!/bin/x\n"])
def test_directory(tmp_path, comment, front):
    path = package(tmp_path, PAGES, comment, front)
    assert payloads(path) == PAGES
    if not front and not comment.startswith(b"PK"):  # another reader agrees; the signature in a comment leads it astray
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX}
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_zip64(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)  # every size and offset is written to ZIP64 fields
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = package(tmp_path, PAGES)
    assert b"PK\x06\x06" in Path(path).read_bytes()
    assert payloads(path) == PAGES


def test_blocks_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_RECORDS", 3)
    monkeypatch.setattr(warc, "INDEX_BYTES", 7)
    pages = [f"page {k}".encode() for k in range(10)]
    path = package(tmp_path, pages)
    assert [len(lengths) for _, _, lengths in warc.package_blocks(path)] == [3, 3, 3, 1]
    assert payloads(path) == pages
    monkeypatch.setattr(warc, "BLOCK_BYTES", 1)  # a larger record is alone
    assert [len(lengths) for _, _, lengths in warc.package_blocks(path)] == [1] * 10


def test_packages_are_bounded(spark, monkeypatch, tmp_path):
    rows = spark.createDataFrame([(k, "u", f"{k}", None) for k in range(50)], "page_id long, url string, html string, refers_to long").coalesce(1)
    before = warc.PACKAGE_RECORDS
    try:
        warc.PACKAGE_RECORDS = 20
        full = warc.Package(str(tmp_path))
        for k in range(20):
            assert not full.full()
            full.add(k, warc.warc_record(k, "u", b"", "", None))
        assert full.full()
        full.close()
    finally:
        warc.PACKAGE_RECORDS = before
    got = warc.write_archives(rows, str(tmp_path)).collect()
    assert [r["records"] for r in got] == [50] and os.path.exists(got[0]["path"])


def test_broken_packages_are_errors(tmp_path):
    path = package(tmp_path, PAGES)
    data = Path(path).read_bytes()
    Path(path).write_bytes(data[:-30])
    with pytest.raises(ValueError, match="no ZIP directory"):
        payloads(path)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, b"x" * 1000)
        z.writestr(warc.INDEX, b"")
    Path(path).write_bytes(buffer.getvalue())
    with pytest.raises(ValueError, match="compressed"):
        payloads(path)
    good = warc.warc_record(1, "u", b"abc", warc.payload_digest(b"abc"), None)
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good.replace(b"abc", b"abd"), good[:-6], b"nothing"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    assert zlib.decompress(zlib.compress(good, 4, wbits=31), wbits=31) == good
