"""Aggregate expressions and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_values(order: list[Column], value: Column, keep: Column | None = None) -> Column:
    """Array of ``value`` in ``order``, NULL values kept, NULL when no row qualifies.

    Collects a whole group into one array: group by a key whose groups are bounded.
    """
    fields = [what.alias(f"o{i}") for i, what in enumerate(order)]
    pair = F.struct(*fields, value.alias("v"))
    rows = F.collect_list(pair if keep is None else F.when(keep, pair))
    values = F.transform(F.array_sort(rows), lambda entry: entry["v"])
    return F.when(F.size(rows) > 0, values)


def group_or_whole(frame: DataFrame, keys: list[str], fixed: dict[str, object]) -> tuple:
    """Grouping for "all entities" or "the selected one".

    Keys with a selected value are dropped from the grouping; if none is left the aggregate is
    global, which yields one row even when no input row remains.
    """
    free = [key for key in keys if fixed.get(key) is None]
    named = [F.lit(fixed[key]).alias(key) for key in keys if fixed.get(key) is not None]
    return (frame.groupBy(*free) if free else frame.groupBy()), named
