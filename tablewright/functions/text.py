"""String expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_name(forename: str, surname: str) -> Column:
    """``forename surname``, a NULL part counting as empty text (the blank stays)."""
    empty = F.lit("")
    return F.concat(F.coalesce(F.col(forename), empty), F.lit(" "), F.coalesce(F.col(surname), empty))


def card_label(name: Column) -> Column:
    """``total_points`` -> ``Total Points``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def contains_any(column: Column, parts: Sequence[str], ignore_case: bool = False) -> Column:
    """True where ``column`` holds at least one of ``parts``; case matters by default."""
    if ignore_case:
        column, parts = F.lower(column), [part.lower() for part in parts]
    return reduce(lambda left, right: left | right, (column.contains(part) for part in parts), F.lit(False))


def first_character(column: Column) -> Column:
    """First character of a code, numeric or text."""
    return F.substring(column.cast("string"), 1, 1)
