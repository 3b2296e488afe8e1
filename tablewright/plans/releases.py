"""Release dashboard: periods, period-over-period cards, brushed cards, charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.dates import decade_end, decade_of, decade_start, previous_range
from tablewright.functions.numbers import change_rate, direction
from tablewright.operators.filters import bound, brush, within

# Card label -> averaged measure.  "Average Budget" averages US_Gross, as the dashboard does;
# pass another mapping to average Production_Budget.
MEASURES = {
    "Average Gross": "Worldwide_Gross",
    "Average Budget": "US_Gross",
    "Average Runtime": "Running_Time_min",
    "Average Rating": "IMDB_Rating",
}
TOTAL = "Total Movies"


def _released(movies: DataFrame, low: datetime, high: datetime) -> Column:
    day = "Release_Date"
    return F.col(day).between(bound(movies, day, low), bound(movies, day, high))


def _both_periods(movies: DataFrame, start: datetime, end: datetime) -> tuple[DataFrame, Column, Column]:
    """Rows of either period, read once, and the two membership tests.  All bounds belong to both
    windows, so a row on the shared day is in both."""
    earlier_start, earlier_end = previous_range(start, end)
    rows = within(movies, "Release_Date", min(earlier_start, start), max(earlier_end, end))
    return (
        rows,
        _released(movies, start, end),
        _released(movies, earlier_start, earlier_end),
    )


def period_rows(movies: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows of the chosen period and of the equally long one before it, tagged."""
    rows, current, previous = _both_periods(movies, start, end)
    tags = F.array_compact(F.array(F.when(current, F.lit("current")), F.when(previous, F.lit("previous"))))
    return rows.select("*", F.explode(tags).alias("period"))


def period_cards(
    movies: DataFrame, start: datetime, end: datetime, measures: Mapping[str, str] = MEASURES
) -> DataFrame:
    """Count and means of both periods, change rate and direction; one row per card.

    One pass with conditional aggregates.  A previous mean of zero or none gives no rate; the
    count's rate is then zero.
    """
    rows, current, previous = _both_periods(movies, start, end)
    totals = rows.agg(
        F.count_if(current).cast("double").alias("now0"),
        F.count_if(previous).cast("double").alias("then0"),
        *[
            F.avg(F.when(test, F.nanvl(F.col(name).cast("double"), F.lit(None)))).alias(f"{side}{i}")
            for i, name in enumerate(measures.values(), start=1)
            for side, test in (("now", current), ("then", previous))
        ],
    )
    entries = [
        F.struct(
            F.lit(i + 1).alias("place"),
            F.lit(label).alias("card"),
            F.col(f"now{i}").alias("current"),
            F.col(f"then{i}").alias("previous"),
        )
        for i, label in enumerate([TOTAL, *measures])
    ]
    rate = change_rate(F.col("current"), F.col("previous"))
    rate = F.when(F.col("card") == TOTAL, F.coalesce(rate, F.lit(0.0))).otherwise(rate)
    return (
        totals.select(F.inline(F.array(*entries)))
        .withColumn("rate", rate)
        .withColumn("direction", direction(F.col("rate")))
    )


def brushed_cards(
    movies: DataFrame, ranges: Mapping[str, tuple], measures: Mapping[str, str] = MEASURES
) -> DataFrame:
    """Count and means of the rows inside a rectangle of two or more measures."""
    return brush(movies, ranges).agg(
        F.count("*").alias("total_movies"),
        *[
            F.avg(F.nanvl(F.col(name).cast("double"), F.lit(None))).alias(label.lower().replace(" ", "_"))
            for label, name in measures.items()
        ],
    )


def genre_counts(movies: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Releases per genre and date; genres with the most releases first.

    The window sees one row per genre and date, so it is bounded by the calendar.
    """
    counts = (
        within(movies, "Release_Date", start, end)
        .groupBy("Major_Genre", "Release_Date")
        .agg(F.count("*").alias("count"))
    )
    return (
        counts.withColumn("genre_total", F.sum("count").over(Window.partitionBy("Major_Genre")))
        .select("Major_Genre", "Release_Date", "count", "genre_total")
        .orderBy(
            F.desc("genre_total"), F.col("Major_Genre").asc_nulls_last(), F.col("Release_Date").asc_nulls_last()
        )
    )


def scatter_rows(movies: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Budget against rating with the tooltip columns."""
    return within(movies, "Release_Date", start, end).select(
        "Title", "Production_Budget", "IMDB_Rating", "Worldwide_Gross", "Major_Genre"
    )


def decade_rows(movies: DataFrame, decades: Sequence[int] | None = None) -> DataFrame:
    """Rows tagged with the decade windows they fall in.

    A window runs from 1 January to 1 January ten years on, both included, so a release at the
    very start of a decade belongs to the one before it as well.
    """
    own = decade_of(F.col("Release_Date"))
    at_start = F.col("Release_Date") == decade_start(own)
    memberships = F.array_compact(F.array(own, F.when(at_start, own - 10)))
    tagged = movies.select("*", F.explode(memberships).alias("decade"))
    if decades is not None:
        tagged = within(
            tagged, "Release_Date", datetime(min(decades), 1, 1), datetime(max(decades) + 10, 1, 1)
        ).filter(F.col("decade").isin(list(decades)))
    return tagged.withColumns(
        {"decade_start": decade_start(F.col("decade")), "decade_end": decade_end(F.col("decade"))}
    )
