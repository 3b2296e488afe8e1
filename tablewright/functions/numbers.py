"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Area scale of a bubble, and the factor between the two bubble sizes.
BUBBLE_SCALE = 2.666051223553066e-05
BUBBLE_FACTOR = 6


def bubble_size(population: Column) -> Column:
    return F.sqrt(population * F.lit(BUBBLE_SCALE))


def leading_digit(code: Column) -> Column:
    """Tens bucket of an integer code: 12 -> 1.  Integer division, never ``/``."""
    return F.call_function("div", code, F.lit(10))


def text_to_float(text: Column) -> Column:
    """Float value of a text column; text such as ``1:02.1`` becomes NULL."""
    return text.try_cast("float")


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; NULL for a zero or missing denominator."""
    return F.try_divide(numerator, denominator)


def change_rate(current: Column, previous: Column) -> Column:
    return ratio(current - previous, previous)


def direction(rate: Column) -> Column:
    """``increase`` for a positive rate; zero, negative and missing rates are ``decrease``."""
    return F.when(rate > 0, F.lit("increase")).otherwise(F.lit("decrease"))


def nan_to_null(frame: DataFrame) -> DataFrame:
    """Every NaN in a float column becomes NULL, so that means skip it."""
    floats = [name for name, kind in frame.dtypes if kind in ("double", "float")]
    return frame.withColumns(
        {name: F.when(~F.isnan(f"`{name}`"), F.col(f"`{name}`")) for name in floats}
    )
