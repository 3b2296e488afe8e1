"""Cards and parameter-driven row selection."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from tablewright.operators.filters import optional_in
from tablewright.operators.reshape import cards, stacked


def stat_cards(*results: DataFrame) -> DataFrame:
    """One-row results as labelled cards, one row per column."""
    return stacked([cards(result) for result in results])


def parameter_rows(frame: DataFrame, column: str, parameter: Any) -> DataFrame:
    """Rows whose ``column`` is the parameter's value or one of its values; none if it is missing."""
    return optional_in(frame, column, parameter, on_empty="none")
