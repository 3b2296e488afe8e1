"""SQL text over registered tables and over frames in hand."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, text: str, values: dict[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """Run ``text`` with bound ``:name`` values; ``{name}`` stands for a frame passed by name.

    Values are bound as typed literals, never spliced into the text.
    """
    return spark.sql(text, args=values or {}, **frames)


def records(spark: SparkSession, rows: list[dict[str, Any]], schema: str) -> DataFrame:
    """Inline records as a frame."""
    return spark.createDataFrame(rows, schema)
