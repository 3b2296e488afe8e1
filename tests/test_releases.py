"""Period cards, brushes and decades."""

from __future__ import annotations

from datetime import datetime

import pytest
from tablewright.functions.dates import previous_range
from tablewright.plans import releases
from tablewright.schemas import MOVIES


@pytest.fixture(scope="module")
def movies(spark):
    nan = float("nan")
    return spark.createDataFrame(
        [
            ("start", "Drama", datetime(2010, 1, 1), 10.0, 100.0, 50.0, 6.0, 90.0),
            ("end", "Drama", datetime(2011, 1, 1), 20.0, None, 70.0, 8.0, nan),
            ("after", "Action", datetime(2011, 1, 1, 1), 20.0, 1.0, 1.0, 1.0, 1.0),
            ("before", "Action", datetime(2009, 6, 1), 30.0, 200.0, 0.0, nan, 100.0),
            ("edge", None, datetime(2009, 1, 1), 5.0, 0.0, 0.0, None, 110.0),
            ("undated", "Action", None, 5.0, 7.0, 7.0, 7.0, 7.0),
        ],
        MOVIES,
    )


START, END = datetime(2010, 1, 1), datetime(2011, 1, 1)


def test_previous_range():
    assert previous_range(START, END) == (datetime(2009, 1, 1), datetime(2010, 1, 1))
    assert previous_range(datetime(1, 1, 1), datetime(2011, 1, 1)) == (datetime(1, 1, 1), datetime(2011, 1, 1))


def test_both_ends_belong_to_both_periods(movies):
    tagged = sorted((row["Title"], row["period"]) for row in releases.period_rows(movies, START, END).collect())
    assert tagged == [
        ("before", "previous"),
        ("edge", "previous"),
        ("end", "current"),
        ("start", "current"),
        ("start", "previous"),
    ]


def test_cards(movies):
    cards = {row["card"]: row for row in releases.period_cards(movies, START, END).collect()}
    assert list(cards) == ["Total Movies", "Average Gross", "Average Budget", "Average Runtime", "Average Rating"]

    def card(name):
        row = cards[name]
        return row["current"], row["previous"], row["rate"], row["direction"]

    assert card("Total Movies") == (2.0, 3.0, pytest.approx(-1 / 3), "decrease")
    assert card("Average Gross") == (100.0, 100.0, 0.0, "decrease")
    assert card("Average Budget") == (60.0, pytest.approx(50 / 3), pytest.approx(2.6), "increase")
    assert card("Average Runtime") == (90.0, 100.0, pytest.approx(-0.1), "decrease")
    assert card("Average Rating") == (7.0, 6.0, pytest.approx(1 / 6), "increase")


def test_empty_previous_period(movies):
    rows = releases.period_cards(movies, datetime(2009, 1, 1, 1), datetime(2009, 12, 31)).collect()
    assert [(row["previous"], row["rate"], row["direction"]) for row in rows][:2] == [
        (1.0, 0.0, "decrease"),
        (0.0, None, "decrease"),
    ]
    rows = releases.period_cards(movies, datetime(2009, 1, 2), datetime(2009, 12, 31)).collect()
    assert rows[0]["previous"] == 1.0
    rows = releases.period_cards(movies, datetime(1999, 1, 2), datetime(1999, 12, 31)).collect()
    assert [(row["current"], row["previous"], row["rate"]) for row in rows][:2] == [(0.0, 0.0, 0.0), (None, None, None)]


def test_brush(movies):
    row = releases.brushed_cards(movies, {"Production_Budget": (10, 20), "IMDB_Rating": (5, 9)}).first()
    assert (row["total_movies"], row["average_budget"], row["average_rating"]) == (2, 60.0, 7.0)
    nothing = releases.brushed_cards(movies, {"Production_Budget": (1000, 2000)}).first()
    assert (nothing["total_movies"], nothing["average_gross"]) == (0, None)


def test_genres_by_total(movies):
    rows = releases.genre_counts(movies).collect()
    assert [(row["Major_Genre"], row["genre_total"]) for row in rows] == [
        ("Action", 3),
        ("Action", 3),
        ("Action", 3),
        ("Drama", 2),
        ("Drama", 2),
        (None, 1),
    ]
    assert sum(row["count"] for row in rows) == movies.count()


def test_decades_share_their_border(movies):
    tagged = sorted((row["Title"], row["decade"]) for row in releases.decade_rows(movies).collect())
    assert tagged == [
        ("after", 2010),
        ("before", 2000),
        ("edge", 2000),
        ("end", 2010),
        ("start", 2000),
        ("start", 2010),
    ]
    assert [row["Title"] for row in releases.decade_rows(movies, [1990]).collect()] == []


def test_scatter_columns(movies):
    assert releases.scatter_rows(movies, START, END).columns == [
        "Title",
        "Production_Budget",
        "IMDB_Rating",
        "Worldwide_Gross",
        "Major_Genre",
    ]
