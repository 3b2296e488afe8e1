"""Every query with SQL against that SQL, on the small tables."""

from __future__ import annotations

import duckdb
import pytest
from comparing import rows_of

from tablewright.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    answer = duck.sql(queries.SQL[name])
    frame = queries.QUERIES[name](spark, FOLDER)
    assert sorted(frame.columns) == sorted(answer.columns)
    assert rows_of(frame.columns, [tuple(row) for row in frame.collect()]) == rows_of(answer.columns, answer.fetchall())
