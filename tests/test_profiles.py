"""Snapshot, creature statistics and distributions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tablewright.operators import distribution as dist
from tablewright.plans import creatures, snapshot
from tablewright.schemas import COUNTRY_YEARS, CREATURES


@pytest.fixture(scope="module")
def countries(spark):
    return spark.createDataFrame(
        [
            ("a", "X", 1952, 50.0, 9999.99, 1e6),
            ("b", "X", 1952, 51.0, 10000.0, 1e6),
            ("c", "Y", 1957, 52.0, 300.0, 4e6),
            ("d", "Y", 1962, 53.0, 40000.0, None),
        ],
        COUNTRY_YEARS,
    )


def test_snapshot_is_strictly_below_the_limit(countries):
    row = snapshot.year_snapshot(countries, 1952).collect()
    assert [r["country"] for r in row] == ["a"]
    assert row[0]["size"] == pytest.approx(math.sqrt(1e6 * 2.666051223553066e-05))
    assert row[0]["size_hvplot"] == pytest.approx(6 * row[0]["size"])


def test_bounds_use_everything(countries):
    assert tuple(snapshot.axis_bounds(countries).first()) == (200.0, pytest.approx(10999.99))


def test_year_steps(countries):
    assert [row["year"] for row in snapshot.years(countries).collect()] == [1952, 1957, 1962]
    assert snapshot.default_year(countries).first()["year"] == 1962
    assert dict(tuple(row) for row in snapshot.next_years(countries).collect()) == {1952: 1957, 1957: 1962, 1962: 1952}
    assert snapshot.next_year(countries).first()["next_year"] == 1962
    assert snapshot.next_year(countries, 1962).first()["next_year"] == 1952
    alone = countries.filter("year = 1957")
    assert snapshot.next_year(alone, 1957).first()["next_year"] == 1957


@pytest.fixture(scope="module")
def table(spark):
    def creature(number, kind, hp, attack=10, defense=5):
        return (number, f"N{number}", kind, hp, attack, defense, 7, 8, 9, 1, "False")

    rows = [creature(i, "Bug", hp) for i, hp in enumerate([10, 20, 20, 30, 45, 60, 61, 80])]
    rows += [creature(100, "Ice", 50)]
    rows += [creature(200 + i, "Rock", 70) for i in range(3)]
    rows += [creature(300, "Void", 5, 3, 0), creature(301, "Void", 6, 4, 2)]
    return spark.createDataFrame(rows, CREATURES)


def test_type_counts_and_choice(table):
    assert [tuple(row) for row in creatures.type_counts(table).collect()] == [("Bug", 8), ("Ice", 1), ("Rock", 3), ("Void", 2)]
    assert creatures.of_types(table, ["Bug", "Ice"]).count() == 9
    assert creatures.of_types(table, ["Bug", "All", "Bug"]).count() == 8 + 14
    assert creatures.of_types(table, []).count() == 0
    assert "Legendary" not in creatures.cleaned(table).columns


@pytest.mark.parametrize("kind", ["Bug", "Ice", "Rock"])
def test_histogram_matches_numpy(table, kind):
    values = np.array([row["HP"] for row in table.filter(F.col("`Type 1`") == kind).collect()], dtype=float)
    counts, edges = np.histogram(values, bins="auto")
    rows = creatures.attribute_histogram(table, "HP", [kind]).collect()
    assert {row["bins"] for row in rows} == {len(counts)}
    assert {row["bin"]: row["count"] for row in rows} == {i: int(c) for i, c in enumerate(counts) if c}
    for row in rows:
        assert row["bin_start"] == pytest.approx(edges[row["bin"]])
        assert row["bin_end"] == pytest.approx(edges[row["bin"] + 1])


def test_ratio_attribute_skips_a_zero_divisor(table):
    rows = creatures.attribute_histogram(table, "Attack / Defense", ["Void"]).collect()
    assert sum(row["count"] for row in rows) == 1


def test_density_is_a_scaled_gaussian_sum(table):
    values = np.array([10, 20, 20, 30, 45, 60, 61, 80], dtype=float)
    rows = sorted(creatures.attribute_density(table, "HP", ["Bug", "Ice", "Rock"]).collect(), key=lambda r: r["point"])
    assert {row["group"] for row in rows} == {"Bug"}
    assert len(rows) == 200
    h = values.std(ddof=1) * len(values) ** -0.2
    counts, edges = np.histogram(values, bins="auto")
    area = len(values) * (edges[1] - edges[0])
    for row in rows:
        kernel = np.exp(-0.5 * ((row["x"] - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        assert row["density"] == pytest.approx(kernel * area, rel=1e-9)


def test_density_integrates_to_about_the_area(spark):
    frame = spark.range(4000).select(F.lit("g").alias("Type 1"), (F.sin(F.col("id") * 7.13) + F.sin(F.col("id") * 3.7) + F.sin(F.col("id") * 1.9)).alias("HP"))
    values = dist.present(frame, "Type 1", "HP")
    stats = dist.summary(values)
    rows = dist.density(values, stats, dist.fixed_bins(stats, 20), True, points=400).collect()
    width = stats.first()
    step = (width["high"] - width["low"]) / 399
    area = sum(row["density"] for row in rows) * step
    assert area == pytest.approx(4000 * (width["high"] - width["low"]) / 20, rel=0.1)


PROBABILITIES = (0.0, 0.25, 0.5, 0.75, 1.0)
SHAPES = {
    "wide": "exp(sin(id * 1.7) * 300) * (id % 3 - 1)",
    "narrow": "1 + sin(id) * 1e-9",
    "ties": "double(id % 7)",
    "equal": "42D",
    "heavy": "pow(id + 1, -40D)",
}


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("pieces", [2, 1024])
def test_quantiles_are_exact(spark, monkeypatch, few, pieces):
    monkeypatch.setattr(dist, "PIECES", pieces)
    monkeypatch.setattr(dist, "CELLS", 1 if pieces == 2 else 1024)
    shapes = SHAPES if pieces > 2 else {"ties": SHAPES["ties"], "small": "CASE WHEN id < 40 THEN sin(id) END"}
    frame = None
    for name, value in shapes.items():
        part = spark.range(3000).selectExpr(f"'{name}' AS g", f"{value} AS v")
        frame = part if frame is None else frame.unionByName(part)
    rows = dist.present(frame, "g", "v")
    got = dist.group_quantiles(rows, dist.summary(rows, PROBABILITIES), few).collect()
    values = {}
    for row in rows.collect():
        values.setdefault(row["group"], []).append(row["value"])
    assert len(got) == len(PROBABILITIES) * len(shapes)
    for row in got:
        assert row["quantile"] == pytest.approx(np.quantile(values[row["group"]], row["probability"]), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("wrong", [(600.0, 700.0), (-5.0, -4.0), (2000.0, 3000.0), (0.0, 0.5)])
def test_a_rank_outside_its_bracket_is_found(spark, wrong):
    rows = dist.present(spark.range(1000).selectExpr("'g' AS g", "double(id) AS v"), "g", "v")
    lead = f"transform(brackets, b -> struct(b.at, b.probability, b.rank, {wrong[0]}D AS `from`, {wrong[1]}D AS `to`))"
    misled = dist.summary(rows, (0.5, 0.9)).withColumn("brackets", F.expr(lead))
    got = {row["probability"]: row["quantile"] for row in dist.group_quantiles(rows, misled, True).collect()}
    assert got == pytest.approx({0.5: 499.5, 0.9: 899.1})


def test_a_summary_is_one_pass(spark):
    frame = spark.createDataFrame([("a", 1e9 + i % 5) for i in range(100)] + [("b", 3.0), ("c", None), (None, 1.0)], "g STRING, v DOUBLE")
    rows = {row["group"]: row for row in dist.summary(dist.present(frame, "g", "v")).collect()}
    assert sorted(rows) == ["a", "b"]
    assert rows["a"]["deviation"] == pytest.approx(np.std([i % 5 for i in range(100)], ddof=1), rel=1e-8)
    assert (rows["a"]["total"], rows["a"]["low"], rows["a"]["high"]) == (100, 1e9, 1e9 + 4)
    assert rows["b"]["deviation"] is None and rows["b"]["total"] == 1


def test_bins_need_another_pass_only_where_uncertain(spark, monkeypatch):
    passes = []
    narrowed = dist.narrowed
    monkeypatch.setattr(dist, "narrowed", lambda *given: passes.append(1) or narrowed(*given))
    frame = spark.range(5000).selectExpr("'g' AS g", "exp(sin(id)) AS v")
    values = dist.present(frame, "g", "v")
    plain = np.histogram_bin_edges([row["value"] for row in values.collect()], bins="auto")
    for cells in (1024, 1):
        monkeypatch.setattr(dist, "CELLS", cells)
        stats = dist.summary(values)
        (row,) = dist.automatic_bins(values, stats, True).collect()
        assert row["bins"] == len(plain) - 1 and row["start"] == plain[0]
        assert bool(passes) == (cells == 1)


@pytest.mark.parametrize("error", [1e-4, 1e-9, 1e-13])
def test_density_keeps_its_error(spark, error):
    frame = spark.range(2000).selectExpr("'g' AS g", "CASE WHEN id = 0 THEN 30 ELSE sin(id) + sin(id * 3.3) * 2 END AS v")
    values = dist.present(frame, "g", "v")
    stats = dist.summary(values)
    rows = dist.density(values, stats, dist.fixed_bins(stats, 20), True, error=error).collect()
    data = np.array([row["value"] for row in values.collect()])
    h = data.std(ddof=1) * len(data) ** -0.2
    for row in rows:
        exact = np.exp(-0.5 * ((row["x"] - data) / h) ** 2).sum() * (data.max() - data.min()) / 20 / (h * math.sqrt(2 * math.pi))
        if exact > 1e-100:
            assert row["density"] == pytest.approx(exact, rel=max(error, 1e-12))


def test_every_value_reaches_every_point(spark):
    frame = spark.createDataFrame([("g", float(v)) for v in [0, 1, 2, 3, 1000]], "g STRING, v DOUBLE")
    values = dist.present(frame, "g", "v")
    stats = dist.summary(values)
    whole = {r["point"]: r["density"] for r in dist.density(values, stats, dist.fixed_bins(stats, 5), True, bandwidth=0.02).collect()}
    near = {r["point"]: r["density"] for r in dist.density(values, stats, dist.fixed_bins(stats, 5), True, bandwidth=0.02, reach=3).collect()}
    assert all(value > 0 for point, value in whole.items() if point < 30) and near[29] == 0


def test_many_genres(spark):
    movies = spark.range(200_000).selectExpr("concat('g', id % 100000) AS Major_Genre", "DATE '2000-01-01' AS Release_Date")
    from tablewright.plans import releases

    found = releases.genre_counts(movies)
    assert found.count() == 100_000 and found.filter("genre_total != 2").count() == 0


def test_radar_ring(table):
    rows = sorted(creatures.radar(table, ["N100"]).collect(), key=lambda row: row["position"])
    assert [row["spoke"] for row in rows] == ["HP", "Attack", "Defense", "Sp. Atk", "Sp. Def", "Speed", "HP"]
    assert [row["value"] for row in rows] == [50.0, 10.0, 5.0, 7.0, 8.0, 9.0, 50.0]
    assert [row["angle"] for row in rows] == pytest.approx(list(np.linspace(0, 2 * np.pi, 7, endpoint=False)))
