"""Option lists: the values a filter offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.sources.files import read_parquet, write_parquet


def option_list(frame: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column as sorted text."""
    values = frame.select(F.col(f"`{column}`").cast("string").alias(column)).distinct()
    return values.orderBy(F.col(column).asc_nulls_last())


def save_options(frame: DataFrame, column: str, path: str) -> DataFrame:
    """Write the option list once and hand back the stored copy."""
    write_parquet(frame.select(F.col(f"`{column}`").cast("string").alias(column)).distinct(), path)
    return read_parquet(frame.sparkSession, path)


def option_values(options: DataFrame, limit: int = 100_000) -> list:
    """The list itself, for a widget.  A list too long for a widget is refused, not cut."""
    rows = options.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} options; filter the list first")
    return [row[0] for row in rows]
