"""Selections made on a dashboard, as ordinary DataFrame filters.

Values arrive as Python arguments and become literals of the logical plan, so simple ones
reach the Parquet scan.  ``None`` means "nothing selected".
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(value: Any) -> list:
    """One value, several, or none, as a list."""
    if value is None:
        return []
    if isinstance(value, (str, bytes)) or not isinstance(value, Iterable):
        return [value]
    return list(value)


def optional_eq(frame: DataFrame, column: str, value: Any | None) -> DataFrame:
    """Rows whose ``column`` equals ``value``; every row when there is no value."""
    if value is None:
        return frame
    return frame.filter(F.col(f"`{column}`") == F.lit(value))


def optional_in(frame: DataFrame, column: str, values: Any, on_empty: str = "all") -> DataFrame:
    """Rows whose ``column`` is one of ``values``.

    ``on_empty`` decides what no values mean: ``"all"`` (an unused filter) or ``"none"``
    (a required parameter that is missing).
    """
    if on_empty not in ("all", "none"):
        raise ValueError("on_empty is 'all' or 'none'")
    chosen = as_list(values)
    if chosen:
        return frame.filter(F.col(f"`{column}`").isin(chosen))
    return frame if on_empty == "all" else frame.filter(F.lit(False))


def excluding(frame: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose ``column`` is none of ``values``; a NULL is never kept."""
    return frame.filter(~F.col(f"`{column}`").isin(list(values)))


def bound(frame: DataFrame, column: str, value: Any) -> Column:
    """``value`` as a literal of the column's own type.

    A Python date or datetime is taken as wall-clock time, whatever zone the driver runs in.
    """
    if isinstance(value, date):
        return F.lit(str(value)).cast(frame.schema[column].dataType)
    return F.lit(value)


def within(frame: DataFrame, column: str, low: Any, high: Any) -> DataFrame:
    """Inclusive range; a missing bound is open."""
    if low is not None:
        frame = frame.filter(F.col(f"`{column}`") >= bound(frame, column, low))
    if high is not None:
        frame = frame.filter(F.col(f"`{column}`") <= bound(frame, column, high))
    return frame


def sorted_selection(frame: DataFrame, selected: Any | None, *order: Column) -> DataFrame:
    """Sort the rows of one selected entity.

    The result for all entities stays unsorted: a global order nobody looks at would cost one more
    shuffle of the whole result and a second run of the stage before it.
    """
    return frame if selected is None else frame.orderBy(*order)


def brush(frame: DataFrame, ranges: Mapping[str, tuple[Any, Any]]) -> DataFrame:
    """Rows inside a rectangle drawn over several measures."""
    for column, (low, high) in ranges.items():
        frame = within(frame, column, low, high)
    return frame


def with_keys(frame: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows in which no key is NULL."""
    for key in keys:
        frame = frame.filter(F.col(f"`{key}`").isNotNull())
    return frame


def matching_keys(frame: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` occurs in the one-column frame ``keys``."""
    return frame.join(keys, column, "left_semi")


def first_match(frame: DataFrame, column: str, value: Any, wanted: str) -> DataFrame:
    """``wanted`` of the first row whose ``column`` is ``value``; the smallest one wins."""
    return (
        frame.filter(F.col(f"`{column}`") == F.lit(value))
        .select(wanted)
        .orderBy(F.col(wanted).asc_nulls_last())
        .limit(1)
    )


def first_row(frame: DataFrame, order: list[Column], *columns: str) -> DataFrame:
    """The first row in ``order``: what a click on a chart hands on."""
    return frame.orderBy(*order).limit(1).select(*(columns or ["*"]))


def recent_years(moment: Column, watermark: DataFrame, years: int) -> Column:
    """Predicate ``watermark - year(moment) <= years``, written as a lower bound.

    ``watermark`` is a one-row, one-column frame holding a year.  The bound is made inside that frame, so
    the bare column meets a bare scalar subquery, which a scan of dates can prune by.  Years after
    the watermark pass, as nothing bounds them from above.
    """
    first_year = F.col(watermark.columns[0]) - F.lit(years)
    return moment >= watermark.select(F.make_date(first_year, F.lit(1), F.lit(1))).scalar()


def recent_partitions(year: Column, watermark: DataFrame, years: int) -> Column:
    """The same limit on a year kept as a text partition column."""
    return watermark.scalar() - year.cast("int") <= F.lit(years)
