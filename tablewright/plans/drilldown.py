"""Race drill-down: qualifying against result, laps, pit stops, ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.numbers import text_to_float
from tablewright.functions.text import contains_any
from tablewright.operators.aggregates import ordered_values
from tablewright.operators.filters import optional_eq, sorted_selection
from tablewright.operators.joins import join_splittable
from tablewright.operators.windows import keyed, previous_value, running_totals

# Status texts that hint at an incident.
INCIDENTS = ("crash", "spun")

PAIR = ["raceId", "driverId"]
SERIES = ["lap_times_array", "positions_array", "pit_stop_laps_array"]


def qualifying_vs_race(
    results: DataFrame,
    qualifying: DataFrame,
    races: DataFrame,
    driver_id: int | None = None,
    year: int | None = None,
    constructor_id: int | None = None,
) -> DataFrame:
    """Qualifying place and finishing place of the same start; in race order for a selected driver."""
    starts = optional_eq(optional_eq(results, "driverId", driver_id), "constructorId", constructor_id)
    grid = optional_eq(qualifying, "driverId", driver_id)
    season = optional_eq(races, "year", year).selectExpr("raceId", "year", "name AS race_name", "date")
    both = (
        starts.selectExpr(*PAIR, "positionOrder AS race_position")
        .join(grid.selectExpr(*PAIR, "position AS qualifying_position"), PAIR)
        .join(season, "raceId")
    )
    order = ("date", "raceId", "qualifying_position", "race_position")
    return sorted_selection(both, driver_id, *[F.col(name).asc_nulls_last() for name in order]).select(
        "driverId", "raceId", "year", "race_name", "qualifying_position", "race_position"
    )


def lap_analysis(lap_times: DataFrame) -> DataFrame:
    """Every lap with the place held one lap earlier and its rank by lap time.

    Equal lap times are ranked by lap.  Both windows share one shuffle; a start with more laps than a task's
    share is cut into blocks, for each of the two orders.
    """
    laps = keyed(lap_times, PAIR, store=False)
    with_previous = previous_value(laps, ["lap", "milliseconds"], "position", "prev_position")
    return running_totals(laps.with_rows(with_previous), ["milliseconds", "lap"], {"fastest_lap_rank": F.lit(1)})


def lap_summary(lap_times: DataFrame) -> DataFrame:
    """Per start: place changes, lap time bounds, and the whole ordered arrays.

    One shuffle on (race, driver) serves the window and the aggregate.  A start has the laps of one
    race, which is what bounds its window and arrays; for endless series use ``lap_analysis``, one
    row per lap.
    """
    in_order = Window.partitionBy(*PAIR).orderBy(F.col("lap").asc_nulls_last(), F.col("milliseconds").asc_nulls_last())
    before = F.col("prev_position")
    order = [F.col("lap"), F.col("milliseconds")]
    return (
        lap_times.withColumn("prev_position", F.lag("position").over(in_order))
        .groupBy(*PAIR)
        .agg(
            F.count_if(F.col("position") < before).alias("positions_lost"),
            F.count_if(F.col("position") > before).alias("positions_gained"),
            F.min("milliseconds").alias("best_lap_time_ms"),
            F.avg("milliseconds").alias("avg_lap_time_ms"),
            F.max("milliseconds").alias("worst_lap_time_ms"),
            ordered_values(order, F.col("time")).alias("lap_times_array"),
            ordered_values(order, F.col("position")).alias("positions_array"),
        )
    )


def pit_summary(pit_stops: DataFrame) -> DataFrame:
    """Stops per start, their mean duration, how many durations are not a number, and the laps in order."""
    seconds = text_to_float(F.col("duration"))
    return pit_stops.groupBy(*PAIR).agg(
        F.count("*").alias("total_pit_stops"),
        F.avg(seconds).alias("avg_pit_stop_duration"),
        F.count_if(F.col("duration").isNotNull() & seconds.isNull()).alias("unreadable_durations"),
        ordered_values([F.col("lap"), F.col("stop")], F.col("lap")).alias("pit_stop_laps_array"),
    )


def race_context(
    results: DataFrame, status: DataFrame, incidents: Sequence[str] = INCIDENTS, ignore_case: bool = False
) -> DataFrame:
    """Starters per race, and drivers whose status text holds one of ``incidents``."""
    flagged = (
        status.filter(contains_any(F.col("status"), incidents, ignore_case))
        .select("statusId")
        .distinct()
        .withColumn("incident", F.lit(True))
    )
    return (
        results.select(*PAIR, "statusId")
        .join(flagged, "statusId", "left")
        .groupBy("raceId")
        .agg(
            F.count("*").alias("total_drivers_in_race"),
            F.count_distinct(F.when(F.col("incident"), F.col("driverId"))).alias("incidents_count"),
        )
    )


def race_scorecard(*tables: DataFrame, **choices) -> DataFrame:
    """The single-value part of ``race_drilldown``, which takes the same arguments."""
    return race_drilldown(*tables, **choices).drop(*SERIES)


def _picker(race_id: int | None, driver_id: int | None):
    return lambda frame: optional_eq(optional_eq(frame, "raceId", race_id), "driverId", driver_id)


def race_drilldown(
    results: DataFrame,
    races: DataFrame,
    constructors: DataFrame,
    status: DataFrame,
    qualifying: DataFrame,
    lap_times: DataFrame,
    pit_stops: DataFrame,
    race_id: int | None = None,
    driver_id: int | None = None,
    incidents: Sequence[str] = INCIDENTS,
) -> DataFrame:
    """One row per start: single values, and lap times, places and pit laps as whole ordered arrays.

    Laps, stops and race totals are each aggregated once per key and then joined.  As in the
    analysis this follows, ``positions_lost`` counts laps with a *smaller* place number than
    before, which is a gain on track; the two names are kept as they are.
    """
    pick = _picker(race_id, driver_id)
    race = (
        optional_eq(races, "raceId", race_id)
        .select("raceId", F.col("name").alias("race_name"), F.col("date").alias("race_date"))
        .join(race_context(optional_eq(results, "raceId", race_id), status, incidents), "raceId")
    )
    starts = pick(results).selectExpr(
        *PAIR,
        "constructorId",
        "statusId",
        "grid AS start_position",
        "positionOrder AS finish_position",
        "points AS points_earned",
        "laps AS laps_completed",
        "time AS race_time",
        "fastestLapTime AS fastest_lap_time",
        "fastestLapSpeed AS fastest_lap_speed",
    )
    session = pick(qualifying).selectExpr(
        *PAIR, "q1 AS qualifying_1", "q2 AS qualifying_2", "q3 AS qualifying_3", "position AS qualifying_position"
    )
    return (
        join_splittable(starts, race, ["raceId"])
        .join(session, PAIR, "left")
        .join(lap_summary(pick(lap_times)), PAIR, "left")
        .join(pit_summary(pick(pit_stops)), PAIR, "left")
        .join(constructors.selectExpr("constructorId", "name AS constructor_name"), "constructorId")
        .join(status.selectExpr("statusId", "status AS race_status"), "statusId")
        .selectExpr(
            *PAIR,
            "race_name",
            "race_date",
            "constructor_name",
            "start_position",
            "finish_position",
            "qualifying_1",
            "qualifying_2",
            "qualifying_3",
            "qualifying_position",
            "points_earned",
            "laps_completed",
            "race_time",
            "fastest_lap_time",
            "fastest_lap_speed",
            "race_status",
            "coalesce(positions_lost, 0L) AS positions_lost",
            "coalesce(positions_gained, 0L) AS positions_gained",
            "best_lap_time_ms",
            "avg_lap_time_ms",
            "worst_lap_time_ms",
            "coalesce(total_pit_stops, 0L) AS total_pit_stops",
            "avg_pit_stop_duration",
            "total_drivers_in_race",
            "incidents_count",
            *SERIES,
        )
    )
