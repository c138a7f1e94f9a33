"""WARC archives: round trips, validation of damaged ones, revisits, SQL."""

from __future__ import annotations

import base64
import hashlib
import struct

import duckdb
import pytest
import zstandard
from shared_rows import rows_of

from leaselake.llm.warc import DICTIONARY_MAGIC, SEPARATOR, SQL, build_archive, digest_of, frame_end, parse_record, read_archive, read_archives, record, write_archives

DATE = "2024-01-01T00:00:00Z"
PAGES = [
    (1, "http://a/ü?q=1 2", "<p>one</p>" * 30),
    (2, None, "<p>one</p>" * 30),
    (0, "http://b/", "<p>two ☃</p>"),
    (3, "x\r\ny: z", None),
    (4, "", ""),
    (5, "http://c", "\r\n\r\nWARC/1.1\r\n\x00(\xb5/\xfd"),
    (2, None, "<p>one</p>" * 30),
    (None, "n", "<p>two ☃</p>"),
]
SCHEMA = "page_id long, url string, html string, payload_bytes int, _first int"


def test_record_round_trip():
    for body in (b"", b"x", b"\r\n\r\n", bytes(range(256)) * 9):
        r = parse_record(record(7, "http://a/", body, None, False, DATE))
        assert (r["page_id"], r["payload"], r["payload_bytes"], r["record_type"], r["refers_to"]) == (7, body, len(body), "response", None)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() == digest_of(body)
        v = parse_record(record(8, None, body, 7, True, DATE))
        assert (v["payload"], v["payload_bytes"], v["record_type"], v["refers_to"]) == (None, len(body), "revisit", 7)


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Date: ", b"WARC-Dat: "), (b"hello", b"hellp"), (b"WARC-Type: ", b"WARC-Type "), (b"\r\n\r\n", b"\r\n")])
def test_bad_records(change):
    good = record(1, "u", b"hello", None, False, DATE)
    with pytest.raises(ValueError):
        parse_record(good.replace(*change))
    with pytest.raises(ValueError):
        parse_record(good[:-1])


@pytest.mark.parametrize("n", [1, 3, 500])
def test_archive(n):
    records = [record(i, f"http://host/{i}", f"<html><p>page {i} of the archive</p></html>".encode() * 5, None, False, DATE) for i in range(n)]
    data = build_archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == DICTIONARY_MAGIC
    at, frames = 8 + size, 0
    while at < len(data):
        at, frames = frame_end(data, at), frames + 1
    assert at == len(data) and frames == n
    assert [r["page_id"] for r in read_archive(data + SEPARATOR)] == list(range(n))
    for broken in (data[:-3], data[: 8 + size] + b"junkjunkjunk", data + b"\x00", data[:-9] + b"\xff" * 9):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(read_archive(broken))


@pytest.mark.parametrize("archive_bytes", [1, 16 << 20])
def test_pages(spark, tmp_path, archive_bytes):
    path = str(tmp_path / "w")
    write_archives(spark.createDataFrame([(*p, 0, 0) for p in PAGES], SCHEMA), path, archive_bytes=archive_bytes)
    out = read_archives(spark, path)
    assert rows_of(out, "page_id", "record_type", "refers_to") == sorted(
        [(0, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (None, "revisit", 0)], key=lambda r: tuple((x is not None, str(x)) for x in r)
    )
    for r in out.collect():
        body = next((h or "").encode() for i, _, h in PAGES if i == r["page_id"])
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == digest_of(body)
        assert r["payload"] == (body if r["record_type"] == "response" else None)


def test_small_payloads_are_responses(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string"), path, min_bytes=3)
    assert rows_of(read_archives(spark, path), "page_id", "refers_to") == [(1, None), (2, None), (3, None), (4, 3)]


def test_empty(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(spark.createDataFrame([], SCHEMA), path)
    assert read_archives(spark, path).count() == 0


def test_sql(spark, tmp_path):
    rows = [p for p in PAGES if p[0] is not None]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "p"))
    write_archives(df, str(tmp_path / "w"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    want = con.execute(SQL).fetchall()
    got = [tuple(r) for r in read_archives(spark, str(tmp_path / "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(map(str, want)) == sorted(map(str, got))
