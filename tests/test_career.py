"""Career analyses on a hand-made season, with the traps the schemas allow."""

from __future__ import annotations

from datetime import date

import pytest
from tablewright.plans import career, drilldown
from tablewright.schemas import RACING


@pytest.fixture(scope="module")
def tables(spark):
    def make(name, rows):
        return spark.createDataFrame(rows, RACING[name])

    def result(race, driver, team, status, points, place, grid, rank):
        return (race, driver, team, status, points, place, grid, rank, 50, "1:30", "1:20", 200.0)

    return {
        "drivers": make("drivers", [(1, "Ann", "Lee"), (2, None, "Roy"), (3, "Ann", "Lee"), (4, "Zed", "Idle")]),
        "constructors": make("constructors", [(10, "Red"), (11, "Blue"), (12, "Red")]),
        "circuits": make("circuits", [(100, "North", "N"), (101, "South", "S")]),
        "races": make(
            "races",
            [
                (1, 2000, 100, "A", date(2000, 3, 1)),
                (2, 2000, 101, "B", date(2000, 3, 1)),
                (3, 2000, 100, "A", date(2000, 4, 1)),
                (4, 2001, 100, "A", date(2001, 3, 1)),
            ],
        ),
        "status": make(
            "status", [(1, "Finished"), (2, "+5 Laps"), (3, "Spun off"), (4, "spun"), (5, "+1 Lap"), (6, "crash in pits")]
        ),
        "results": make(
            "results",
            [
                result(1, 1, 10, 1, 10.0, 1, 1, 1),
                result(2, 1, 10, 3, 6.5, 2, 2, None),
                result(3, 1, 11, 4, None, 9, 1, 2),
                result(4, 1, 12, 2, 4.0, 3, 5, 1),
                result(1, 2, 11, 5, 6.0, 2, 3, 2),
                result(3, 2, 11, 6, 0.0, 12, 3, 3),
                result(4, 2, 12, 3, 1.5, 4, 3, 3),
            ],
        ),
        "qualifying": make("qualifying", [(1, 1, 2, "a", "b", "c"), (4, 2, 7, "a", None, None)]),
        "lap_times": make(
            "lap_times",
            [
                (1, 1, 1, 5, "t1", 900),
                (1, 1, 2, 3, "t2", 800),
                (1, 1, 3, None, "t3", 850),
                (1, 1, 4, 4, "t4", 800),
                (1, 1, 5, 6, "t5", 700),
                (1, 2, 1, 2, "u1", 910),
                (3, 2, 1, 1, "v1", 999),
            ],
        ),
        "pit_stops": make(
            "pit_stops", [(1, 1, 4, 2, "1:02.1"), (1, 1, 2, 1, "26.9"), (1, 1, 5, 3, "27.1"), (4, 2, 9, 1, "30")]
        ),
    }


def rows(frame, *columns):
    return [tuple(row) for row in (frame.select(*columns) if columns else frame).collect()]


def test_options_treat_a_missing_name_as_empty(tables):
    assert rows(career.driver_options(tables["drivers"])) == [(1, "Ann Lee"), (3, "Ann Lee"), (4, "Zed Idle"), (2, " Roy")]


def test_name_lookup_takes_the_smallest_id(tables):
    assert rows(career.driver_id_of(tables["drivers"], "Ann Lee")) == [(1,)]
    assert rows(career.driver_id_of(tables["drivers"], "Nobody")) == []


def test_optional_constructor(tables):
    options = career.constructor_options(tables["results"], tables["constructors"], 1)
    assert rows(options) == [(1, 11, "Blue"), (1, 10, "Red"), (1, 12, "Red")]
    assert career.constructor_id_of(options, None) is None
    assert rows(career.constructor_id_of(options, "Red")) == [(10,)]


def test_season_points_merge_teams_of_one_name(tables):
    season = career.season_points(tables["results"], tables["races"], tables["constructors"], driver_id=1)
    assert rows(season) == [(1, 2000, "Blue", None), (1, 2000, "Red", 16.5), (1, 2001, "Red", 4.0)]
    filtered = career.season_points(tables["results"], tables["races"], tables["constructors"], 1, 12)
    assert rows(filtered) == [(1, 2001, "Red", 4.0)]
    assert rows(career.selected_season(season, 1)) == [(2000,)]
    assert rows(career.selected_season(season, 1, 2001)) == [(2001,)]


def test_scorecard(tables):
    card = career.career_scorecard(tables["results"], tables["races"])
    assert sorted(rows(card)) == [(1, 1, 3, 4, 21.0, 2, 2), (2, 0, 1, 3, 8.0, 0, 0)]
    assert rows(career.career_scorecard(tables["results"], tables["races"], 4)) == [(4, 0, 0, 0, None, 0, 0)]
    assert rows(career.career_scorecard(tables["results"], tables["races"], 1, 11), "total_races") == [(1,)]


def test_progression(tables):
    progress = career.season_progression(
        tables["results"], tables["races"], tables["constructors"]
    )
    got = sorted(rows(progress, "driverId", "year", "raceId", "cumulative_points", "index"))
    assert got == [
        (1, 2000, 1, 10.0, 1),
        (1, 2000, 2, 16.5, 2),
        (1, 2000, 3, 16.5, 3),
        (1, 2001, 4, 4.0, 1),
        (2, 2000, 1, 6.0, 1),
        (2, 2000, 3, 6.0, 2),
        (2, 2001, 4, 1.5, 1),
    ]


def test_last_running_total_is_the_season_total(tables):
    args = (tables["results"], tables["races"], tables["constructors"])
    last = {}
    for driver, year, index, total in rows(
        career.season_progression(*args), "driverId", "year", "index", "cumulative_points"
    ):
        if index > last.get((driver, year), (0, 0))[0]:
            last[driver, year] = (index, total)
    totals = {}
    for driver, year, _, points in rows(career.season_points(*args)):
        totals[driver, year] = totals.get((driver, year), 0) + (points or 0)
    assert {key: value[1] for key, value in last.items()} == totals


def test_podium_split(tables):
    split = career.podium_split(tables["results"], tables["races"], driver_id=1, year=2000)
    assert rows(split) == [(1, 2000, 1, "🥇 Wins", 1), (1, 2000, 2, "🥈 Seconds", 1), (1, 2000, 3, "🥉 Thirds", 0)]
    empty = career.podium_split(tables["results"], tables["races"], driver_id=4, year=2000)
    assert rows(empty, "Count") == [(0,), (0,), (0,)]


def test_reasons_leave_out_finishes_up_to_four_laps(tables):
    reasons = career.non_finish_reasons(tables["results"], tables["races"], tables["status"])
    assert sorted(rows(reasons)) == [
        (1, 2000, "Spun off", 1),
        (1, 2000, "spun", 1),
        (1, 2001, "+5 Laps", 1),
        (2, 2000, "crash in pits", 1),
        (2, 2001, "Spun off", 1),
    ]


def test_venues(tables):
    args = (tables["results"], tables["races"], tables["circuits"])
    assert rows(career.venues(*args, driver_id=1), "circuit_name") == [("North",), ("South",)]
    assert rows(career.venues(*args, driver_id=1, start_year=2001), "circuit_name") == [("North",)]


def test_qualifying_needs_both_sides(tables):
    pairs = drilldown.qualifying_vs_race(tables["results"], tables["qualifying"], tables["races"])
    assert sorted(rows(pairs)) == [(1, 1, 2000, "A", 2, 1), (2, 4, 2001, "A", 7, 4)]


DRILL = ("results", "races", "constructors", "status", "qualifying", "lap_times", "pit_stops")


def drill(tables, **choices):
    return drilldown.race_drilldown(*[tables[name] for name in DRILL], **choices)


def test_drilldown(tables):
    found = {(row["raceId"], row["driverId"]): row for row in drill(tables).collect()}
    assert len(found) == 7
    first = found[1, 1]
    assert (first["positions_lost"], first["positions_gained"]) == (1, 1)
    assert (first["best_lap_time_ms"], first["avg_lap_time_ms"], first["worst_lap_time_ms"]) == (700, 810.0, 900)
    assert first["total_pit_stops"] == 3
    assert first["avg_pit_stop_duration"] == pytest.approx(27.0, abs=1e-6)
    assert first["lap_times_array"] == ["t1", "t2", "t3", "t4", "t5"]
    assert first["positions_array"] == [5, 3, None, 4, 6]
    assert first["pit_stop_laps_array"] == [2, 4, 5]
    assert (first["qualifying_1"], first["qualifying_position"]) == ("a", 2)
    assert (first["total_drivers_in_race"], first["incidents_count"]) == (2, 0)
    no_laps = found[4, 2]
    assert (no_laps["lap_times_array"], no_laps["pit_stop_laps_array"]) == (None, [9])
    assert (no_laps["best_lap_time_ms"], no_laps["positions_lost"], no_laps["total_pit_stops"]) == (None, 0, 1)
    silent = found[2, 1]
    assert (silent["lap_times_array"], silent["positions_array"], silent["pit_stop_laps_array"]) == (None, None, None)
    assert found[3, 2]["qualifying_1"] is None
    # "Spun off" does not hold "spun": case matters.
    assert {key: row["incidents_count"] for key, row in found.items()}[3, 1] == 2
    assert found[2, 1]["incidents_count"] == 0


def test_drilldown_of_one_start(tables):
    one = drill(tables, race_id=1, driver_id=1).collect()
    assert len(one) == 1
    assert one[0]["total_drivers_in_race"] == 2
    card = drilldown.race_scorecard(*[tables[name] for name in DRILL], race_id=1, driver_id=1)
    assert not set(drilldown.SERIES) & set(card.columns) and card.count() == 1


def test_arrays_are_whole_whatever_the_lap_numbers(spark, tables):
    schema = tables["lap_times"].schema
    laps = spark.createDataFrame([(1, 1, 4090 + i, i, f"t{i}", 900) for i in range(12)], schema)
    found = drill({**tables, "lap_times": laps}, race_id=1, driver_id=1).collect()
    assert [row["lap_times_array"] for row in found] == [[f"t{i}" for i in range(12)]]


def test_lap_analysis(tables):
    laps = drilldown.lap_analysis(tables["lap_times"])
    got = sorted(rows(laps.filter("raceId = 1 AND driverId = 1"), "lap", "prev_position", "fastest_lap_rank"))
    assert got == [(1, None, 5), (2, 5, 2), (3, 3, 4), (4, None, 3), (5, 4, 1)]


def test_pit_summary_counts_unreadable_durations(tables):
    summary = {(row["raceId"], row["driverId"]): row for row in drilldown.pit_summary(tables["pit_stops"]).collect()}
    assert summary[1, 1]["unreadable_durations"] == 1
    assert summary[4, 2]["unreadable_durations"] == 0


def test_incident_words_can_ignore_case(tables):
    context = drilldown.race_context(tables["results"], tables["status"], ignore_case=True)
    assert dict(rows(context, "raceId", "incidents_count")) == {1: 0, 2: 1, 3: 2, 4: 1}
