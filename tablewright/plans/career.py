"""Career explorer: options, season totals, scorecards, podiums, non-finishes, venues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import full_name
from tablewright.operators.aggregates import group_or_whole
from tablewright.operators.filters import (
    excluding,
    first_match,
    first_row,
    optional_eq,
    sorted_selection,
    within,
)
from tablewright.operators.joins import keep_known
from tablewright.operators.reshape import labelled_counts
from tablewright.operators.windows import keyed, running_totals

# Race outcomes that count as finishing, and the podium labels.
FINISHED = ("Finished", "+1 Lap", "+2 Laps", "+3 Laps", "+4 Laps")
PODIUM = {"wins": "🥇 Wins", "seconds": "🥈 Seconds", "thirds": "🥉 Thirds"}


def _ascending(*names: str) -> list:
    return [F.col(name).asc_nulls_last() for name in names]


def _selected(results: DataFrame, driver_id: int | None, constructor_id: int | None) -> DataFrame:
    return optional_eq(optional_eq(results, "driverId", driver_id), "constructorId", constructor_id)


def driver_options(drivers: DataFrame) -> DataFrame:
    """Id and full name of every driver, sorted by name."""
    return (
        drivers.orderBy(*_ascending("forename", "surname", "driverId"))
        .select("driverId", full_name("forename", "surname").alias("driver_name"))
    )


def driver_id_of(drivers: DataFrame, driver_name: str) -> DataFrame:
    """Id behind a chosen name; of several drivers with that name, the smallest id."""
    named = drivers.select("driverId", full_name("forename", "surname").alias("driver_name"))
    return first_match(named, "driver_name", driver_name, "driverId")


def constructor_options(
    results: DataFrame, constructors: DataFrame, driver_id: int | None = None
) -> DataFrame:
    """Constructors each driver has raced for.

    The fact is reduced to distinct pairs before the dimension is joined.
    """
    pairs = _selected(results, driver_id, None).select("driverId", "constructorId").distinct()
    names = constructors.select("constructorId", F.col("name").alias("constructor_name"))
    found = pairs.join(names, "constructorId").select("driverId", "constructorId", "constructor_name")
    return sorted_selection(found, driver_id, *_ascending("constructor_name", "constructorId"))


def constructor_id_of(options: DataFrame, constructor_name: str | None) -> DataFrame | None:
    """Id behind an optional choice; ``None`` when nothing is chosen, i.e. no filter."""
    if not constructor_name:
        return None
    return first_match(options, "constructor_name", constructor_name, "constructorId")


def season_points(
    results: DataFrame,
    races: DataFrame,
    constructors: DataFrame,
    driver_id: int | None = None,
    constructor_id: int | None = None,
) -> DataFrame:
    """Points per driver, season and constructor.

    The fact is summed by constructor id before the names join, and by name afterwards.
    """
    facts = _selected(results, driver_id, constructor_id).select("driverId", "raceId", "constructorId", "points")
    season = (
        facts.join(races.select("raceId", "year"), "raceId")
        .groupBy("driverId", "year", "constructorId")
        .agg(F.sum("points").alias("points"))
        .join(constructors.select("constructorId", F.col("name").alias("constructor_name")), "constructorId")
        .groupBy("driverId", "year", "constructor_name")
        .agg(F.sum("points").alias("total_points"))
    )
    return sorted_selection(season, driver_id, *_ascending("year", "constructor_name"))


def selected_season(season: DataFrame, driver_id: int, year: int | None = None) -> DataFrame:
    """Year of the first selected bar of the season chart."""
    bars = optional_eq(optional_eq(season, "driverId", driver_id), "year", year)
    return first_row(bars, _ascending("year", "constructor_name"), "year")


def _race_points(
    results: DataFrame,
    races: DataFrame,
    constructors: DataFrame,
    driver_id: int | None,
    constructor_id: int | None,
    extra: Sequence[str] = (),
) -> DataFrame:
    columns = ["driverId", "raceId", "constructorId", "points"]
    extra = [name for name in extra if name not in columns[:2]]
    facts = _selected(results, driver_id, constructor_id).select(*dict.fromkeys([*columns, *extra]))
    return (
        facts.join(races.select("raceId", "year", F.col("name").alias("race_name"), "date"), "raceId")
        .join(constructors.select("constructorId", F.col("name").alias("constructor_name")), "constructorId")
        .select("driverId", "year", "points", "raceId", "constructor_name", "race_name", "date", *extra)
    )


def race_points(
    results: DataFrame,
    races: DataFrame,
    constructors: DataFrame,
    driver_id: int | None = None,
    constructor_id: int | None = None,
) -> DataFrame:
    """Points of every race start; in race order for a selected driver."""
    rows = _race_points(results, races, constructors, driver_id, constructor_id)
    return sorted_selection(rows, driver_id, *_ascending("date", "raceId", "constructor_name", "points"))


def career_scorecard(
    results: DataFrame,
    races: DataFrame,
    driver_id: int | None = None,
    constructor_id: int | None = None,
) -> DataFrame:
    """Wins, podiums, starts, points, pole positions and fastest laps, in one pass.

    For one selected driver there is always one row, with zero counts if they never raced.  ``rank``
    may be a number or, where a source marks gaps with text, a string.
    """
    facts = keep_known(_selected(results, driver_id, constructor_id), races, "raceId")
    grouped, fixed = group_or_whole(facts, ["driverId"], {"driverId": driver_id})
    return grouped.agg(
        F.count_if(F.col("positionOrder") == 1).alias("total_wins"),
        F.count_if(F.col("positionOrder") <= 3).alias("total_podiums"),
        F.count("*").alias("total_races"),
        F.round(F.sum("points"), 0).alias("total_points"),
        F.count_if(F.col("grid") == 1).alias("pole_positions"),
        F.count_if(F.col("rank").cast("string") == "1").alias("fastest_laps"),
    ).select(*fixed, "*")


def season_progression(
    results: DataFrame,
    races: DataFrame,
    constructors: DataFrame,
    driver_id: int | None = None,
    constructor_id: int | None = None,
    tie_break: Sequence[str] = ("constructorId",),
) -> DataFrame:
    """Running points and race number per driver and season.

    Order is race date, then race, then ``tie_break``, which must make it total.  The joined rows are written
    once, and totals are made from that copy.
    """
    rows = _race_points(results, races, constructors, driver_id, constructor_id, tie_break)
    return running_totals(
        keyed(rows, ["driverId", "year"]),
        order=["date", "raceId", *tie_break],
        totals={"cumulative_points": F.col("points"), "index": F.lit(1)},
    )


def podium_split(
    results: DataFrame,
    races: DataFrame,
    driver_id: int | None = None,
    year: int | None = None,
    constructor_id: int | None = None,
) -> DataFrame:
    """First, second and third places per driver and season, one row each."""
    facts = _selected(results, driver_id, constructor_id).select("driverId", "raceId", "positionOrder")
    seasons = optional_eq(races.select("raceId", "year"), "year", year)
    grouped, fixed = group_or_whole(
        facts.join(seasons, "raceId"), ["driverId", "year"], {"driverId": driver_id, "year": year}
    )
    counts = grouped.agg(
        F.count_if(F.col("positionOrder") == 1).alias("wins"),
        F.count_if(F.col("positionOrder") == 2).alias("seconds"),
        F.count_if(F.col("positionOrder") == 3).alias("thirds"),
    ).select(*fixed, "*")
    return labelled_counts(counts, ["driverId", "year"], PODIUM, "Position", "Count")


def non_finish_reasons(
    results: DataFrame,
    races: DataFrame,
    status: DataFrame,
    driver_id: int | None = None,
    year: int | None = None,
    constructor_id: int | None = None,
    finished: Sequence[str] = FINISHED,
) -> DataFrame:
    """How often each status other than ``finished`` ended a race; for a selected driver, most
    frequent first."""
    facts = _selected(results, driver_id, constructor_id).select("driverId", "raceId", "statusId")
    reasons = (
        facts.join(excluding(status.select("statusId", "status"), "status", finished), "statusId")
        .join(optional_eq(races.select("raceId", "year"), "year", year), "raceId")
        .groupBy("driverId", "year", "status")
        .agg(F.count("*").alias("count"))
    )
    return sorted_selection(reasons, driver_id, F.desc("count"), *_ascending("year", "status"))


def venues(
    results: DataFrame,
    races: DataFrame,
    circuits: DataFrame,
    driver_id: int | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """Circuits each driver has raced on, optionally between two seasons."""
    seasons = within(races, "year", start_year, end_year).select("raceId", "circuitId")
    pairs = (
        _selected(results, driver_id, None)
        .select("driverId", "raceId")
        .join(seasons, "raceId")
        .select("driverId", "circuitId")
        .distinct()
    )
    found = pairs.join(
        circuits.select("circuitId", F.col("name").alias("circuit_name"), "country"), "circuitId"
    ).select("driverId", "circuitId", "circuit_name", "country")
    return sorted_selection(found, driver_id, *_ascending("circuit_name", "circuitId"))
