"""Country-year snapshot: bubbles, axis bounds, year stepping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import BUBBLE_FACTOR, bubble_size
from tablewright.operators.filters import optional_eq
from tablewright.operators.windows import cyclic_successor

# Income limit of the charts and the padding of their axis.
INCOME_LIMIT = 10000
PAD_LOW = 100
PAD_HIGH = 1000


def year_snapshot(data: DataFrame, year: int | None = None, limit: float = INCOME_LIMIT) -> DataFrame:
    """Countries below the income limit with their bubble sizes; one row per point.

    ``continent`` is the series key: the long form stands for one series per continent.
    """
    return (
        optional_eq(data, "year", year)
        .filter(F.col("gdpPercap") < limit)
        .withColumn("size", bubble_size(F.col("pop")))
        .withColumn("size_hvplot", F.col("size") * BUBBLE_FACTOR)
    )


def axis_bounds(data: DataFrame, limit: float = INCOME_LIMIT) -> DataFrame:
    """Padded bounds of the income axis, over the whole dataset and in one pass."""
    income = F.col("gdpPercap")
    return data.agg(
        (F.min(income) - PAD_LOW).alias("x_min"),
        (F.max(F.when(income < limit, income)) + PAD_HIGH).alias("x_max"),
    )


def years(data: DataFrame) -> DataFrame:
    """The distinct years, ascending."""
    return data.select(F.col("year").cast("int").alias("year")).distinct().orderBy("year")


def default_year(data: DataFrame) -> DataFrame:
    """The last year."""
    return data.agg(F.max(F.col("year").cast("int")).alias("year"))


def next_years(data: DataFrame) -> DataFrame:
    """Each year with the one that follows it; the last wraps to the first."""
    distinct = data.select(F.col("year").cast("int").alias("year")).distinct()
    return cyclic_successor(distinct, "year", "next_year")


def next_year(data: DataFrame, year: int | None = None) -> DataFrame:
    """The year after ``year``; the last year when none is set yet."""
    if year is None:
        return default_year(data).select(F.col("year").alias("next_year"))
    return next_years(data).filter(F.col("year") == year).select("next_year")
