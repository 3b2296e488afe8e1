"""Decisions found again by row number, with other numbers of cores when each scan is planned."""

from __future__ import annotations

from collections import Counter

import pytest
from cases import SCHEMA

from tablewright.llm import quality_rules, simhash, warc

CORES = "spark.sql.leafNodeDefaultParallelism"
LINE = "all rights reserved by the host of this page"
LONG = [" ".join(f"d{i}w{k}" for k in range(60)) for i in range(48)]


@pytest.fixture
def cores(spark):
    """Sets how many cores scans are planned for."""
    yield lambda n: spark.conf.set(CORES, n)
    spark.conf.unset(CORES)


def in_files(spark, path, rows, schema=SCHEMA, files=16):
    """The rows as a table of 16 files: one partition when planned for one core, 16 for 16."""
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def test_scans_number_rows_otherwise(spark, cores, tmp_path):
    docs = in_files(spark, str(tmp_path / "t"), [(i, "", "en", "s", 0) for i in range(48)])
    cores(1)
    few = docs.rdd.getNumPartitions()
    cores(16)
    assert few < spark.read.parquet(str(tmp_path / "t")).rdd.getNumPartitions()


def test_rejected_documents_go(spark, cores, tmp_path):
    rows = [(i, LONG[i] if i % 3 else "too short", "en", "s", 0) for i in range(48)]
    docs = in_files(spark, str(tmp_path / "t"), rows)
    cores(1)
    left = quality_rules.drop_rejected(docs)
    cores(16)
    assert sorted(tuple(row) for row in left.collect()) == [row for row in rows if row[0] % 3]


def test_near_copies_go(spark, cores, tmp_path):
    rows = [(i, LONG[i % 24], "en", "s", 0) for i in range(48)]
    docs = in_files(spark, str(tmp_path / "t"), rows)
    cores(1)
    left = simhash.drop_near_duplicates(docs)
    cores(16)
    assert sorted(tuple(row) for row in left.collect()) == rows[:24]


def test_frequent_lines_go(spark, cores, tmp_path):
    rows = [(i, LONG[i] + "\n" + LINE if i % 3 else LONG[i], "en", "s", 0) for i in range(48)]
    docs = in_files(spark, str(tmp_path / "t"), rows)
    cores(1)
    left = quality_rules.strip_lines(docs, min_documents=10)
    cores(16)
    assert Counter(row.text for row in left.collect()) == Counter(LONG)


def test_revisits_name_their_responses(spark, cores, tmp_path, monkeypatch):
    pages = [(i // 2, "http://a.com/", "" if i % 3 else f"page {i}") for i in range(48)]
    table = in_files(spark, str(tmp_path / "t"), pages, "page_id bigint, url string, html string")

    def then_more_cores(frame, name, write=warc.stored):
        written = write(frame, name)
        cores(16)
        return written

    monkeypatch.setattr(warc, "stored", then_more_cores)
    cores(1)
    found = warc.archive_and_read(table).collect()
    kinds = Counter((row.record_type, row.payload_bytes, row.refers_to, row.valid) for row in found if row.payload_bytes in (0, None))
    assert kinds == {("response", 0, None, True): 1, ("revisit", 0, 23, True): 31}
    assert len(found) == 48 and all(row.valid for row in found)
