from __future__ import annotations

import base64
import hashlib

import pytest
from cases import CLASHING, ordered, plain

from tablewright.llm import warc

PAGES = [
    (1, "http://a.com/", "same"),
    (2, "http://b.com/x y\r\nz", "same"),
    (3, None, None),
    (4, "http://c.com/é", ""),
    (5, "http://d.com", "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n0\r\n\r\n"),
    (6, "http://e.com", "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n0\r\n\r\n"),
    (7, "http://f.com", "x" * 300_001),
    (7, "http://f.com", "x" * 300_001),
    (None, "http://g.com", "alone"),
    (None, "http://h.com", "same"),
]


def brute(pages, least):
    out, groups = [], {}
    for page_id, _, html in pages:
        groups.setdefault(html or "", []).append(page_id)
    for html, ids in groups.items():
        body = html.encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        known = [i for i in ids if i is not None]
        first = ids.index(max(known) if known else None)
        for at, page_id in enumerate(ids):
            again = at != first and len(body) >= least
            out.append((page_id, len(body), digest, "revisit" if again else "response", ids[first] if again else None, True))
    return ordered(out)


@pytest.mark.parametrize("least, segment, chunk", [(0, 1000, 7), (10, 1 << 15, 1 << 12), (0, 64, 1000)])
def test_round_trip(spark, least, segment, chunk):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    pages = pages.selectExpr("*", *[f"'other' AS `{name}`" for name in CLASHING])
    found = warc.archive_and_read(pages, revisit_from=least, segment_bytes=segment, chunk_bytes=chunk, records_per_file=50)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")
    assert plain(found, *columns) == brute(PAGES, least)


def rows_of(body, segment):
    digest = hashlib.sha1(body.encode()).hexdigest()
    page = {"page_id": 1, "url": "http://a.com", "body": body, "digest": digest, "bytes": len(body.encode()), "kind": "alone"}
    return [row for part in warc.records_of(page, segment, 10) for row in warc.parse(part + b"\r\n\r\n")]


def test_damage_is_noticed():
    rows = rows_of("payload " * 100, 200)
    assert len(rows) > 3
    assert [row["valid"] for row in warc.reassembled(iter(rows))] == [True]
    assert next(warc.reassembled(iter(rows)))["payload_bytes"] == 800
    for broken in (rows[:-1], rows[1:], rows[:1] + rows[2:], rows[:2] + rows[1:], [rows[0] | {"promised": "other"}, *rows[1:]]):
        assert [row["valid"] for row in warc.reassembled(iter(broken))] == [False]


def test_payload_taken_byte_by_byte():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"some\r\nbody\r\n", 5)
    for size in (1, 2, 3, 1000):
        payload = warc.Payload()
        for at in range(0, len(block), size):
            payload.feed(block[at : at + size])
        assert payload.whole and payload.bytes == 12 and payload.digest == warc.base32_sha1(b"some\r\nbody\r\n")
    plain_body = warc.Payload()
    plain_body.feed(b"HTTP/1.1 200 OK\r\n\r\nbody")
    assert plain_body.whole and plain_body.bytes == 4


TRAPS = [
    (1, "http://a.com/WARC/1.1", "WARC/1.1"),
    (2, "http://b.com/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3000),
    (3, "http://c.com/", "x" * 4088 + "WARC/1.1" + "y" * 9 + "WARC/1.1\r\n"),
    (4, "WARC/1.1", "WARC/1.1\r\n\r\n\r\n\r\n" + "\r\n" * 5000),
    *[(10 + i, "http://d.com/", "WAWARC/1.1\r\n" * i) for i in range(300)],
]


@pytest.mark.parametrize("split", [1000, 70_001, 1 << 27])
def test_version_lines_in_payloads_at_any_split(spark, split):
    pages = spark.createDataFrame(TRAPS, "page_id bigint, url string, html string").coalesce(1)
    folder = warc.shared_folder(spark, "warc")
    warc.write_archives(pages, folder)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for name in before:
            spark.conf.set(name, split)
        found = plain(warc.read_archives(spark, folder), *columns)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == brute(TRAPS, 0)
    assert plain(warc.read_archives(spark, folder, whole_files=True), *columns) == found


@pytest.mark.parametrize("least", [0, 5])
def test_rows_equal_in_all_columns(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "COPIES", 64)
    rows = [(None, None, None)] * 1000 + [(7, "http://a.com", "same")] * 65 + [(3, None, "same")] * 66 + [(9, "", "other text")] * 2
    found = warc.archive_and_read(spark.createDataFrame(rows, "page_id bigint, url string, html string"), revisit_from=least)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")
    assert plain(found, *columns) == brute(rows, least)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_and_read(empty).count() == 0
