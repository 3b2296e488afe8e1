"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if value != value else value + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((value is None, str(type(value)), value if value is not None else 0) for value in row))


def compare(frame, connection, statement) -> str | None:
    """None when both agree, else what differs."""
    answer = connection.sql(statement)
    kinds = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "HUGEINT": "hugeint"}
    expected_types = {n: kinds.get(str(t), str(t)) for n, t in zip(answer.columns, answer.types)}
    if dict(frame.dtypes) != expected_types:
        return f"types {dict(frame.dtypes)} != {expected_types}"
    expected = rows_of(answer.columns, answer.fetchall())
    got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    if len(expected) != len(got):
        return f"rows: spark {len(got)} != duckdb {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(bad)} of {len(got)} rows differ, first: spark {bad[0][0]} duckdb {bad[0][1]}" if bad else None
