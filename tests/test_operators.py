"""Filters, joins, windows, reshapes, expressions and sources."""

from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F
from tablewright.functions import dates, numbers, text
from tablewright.operators import filters, joins, reshape, windows
from tablewright.plans import cards, drilldown
from tablewright.schemas import PARAMETER_ROWS
from tablewright.session import shared_folder
from tablewright.sources import catalog, files, options, preview


@pytest.fixture(scope="module")
def people(spark):
    return catalog.records(
        spark,
        [
            {"name": "Ida", "age": 61, "city": "Aarhus", "cid": "K1"},
            {"name": "Omar", "age": 19, "city": "All", "cid": "K2"},
            {"name": "D'Arcy", "age": 44, "city": "Aarhus", "cid": "K1"},
            {"name": "Wen", "age": 30, "city": "Turku", "cid": None},
        ],
        PARAMETER_ROWS,
    )


def names(frame):
    return sorted(row["name"] for row in frame.collect())


def test_parameter_forms(people):
    assert names(cards.parameter_rows(people, "cid", "K2")) == ["Omar"]
    assert names(cards.parameter_rows(people, "cid", ["K1", "K2"])) == ["D'Arcy", "Ida", "Omar"]
    assert names(cards.parameter_rows(people, "cid", [])) == []
    assert names(cards.parameter_rows(people, "cid", None)) == []
    assert names(cards.parameter_rows(people, "cid", "none")) == []
    assert len(names(filters.optional_in(people, "cid", []))) == 4
    with pytest.raises(ValueError):
        filters.optional_in(people, "cid", [], on_empty="some")


def test_optional_filters(people):
    assert len(names(filters.optional_eq(people, "age", None))) == 4
    assert names(filters.optional_eq(people, "city", "All")) == ["Omar"]
    assert names(filters.optional_eq(people, "age", 30)) == ["Wen"]
    assert names(filters.within(people, "age", 19, 30)) == ["Omar", "Wen"]
    assert names(filters.within(people, "age", None, 19)) == ["Omar"]
    assert names(filters.excluding(people, "cid", ["K2"])) == ["D'Arcy", "Ida"]


def test_sql_binds_values(spark, people):
    statement = "SELECT * FROM {df} WHERE :name IS NULL OR name = :name"
    assert names(catalog.query(spark, statement, {"name": "D'Arcy"}, df=people)) == ["D'Arcy"]
    assert len(names(catalog.query(spark, statement, {"name": None}, df=people))) == 4
    assert names(catalog.query(spark, statement, {"name": "' OR 1=1 --"}, df=people)) == []


@pytest.fixture(params=[65_536, 20])
def block_rows(request, monkeypatch):
    """Whole keys, and blocks of 20 rows or what the number of tasks makes of them."""
    monkeypatch.setattr(windows, "BLOCK_ROWS", request.param)
    return request.param


def test_running_totals_agree_with_a_plain_loop(spark, block_rows):
    rows = [
        ("big" if i % 3 else "small", None if i % 50 == 0 else i % 7, i * 7919 % 1009, None if i % 13 == 0 else float(i % 11))
        for i in range(300)
    ]
    frame = spark.createDataFrame([*rows, (None, 1, 1, 1.0)], "k STRING, d INT, o INT, v DOUBLE")
    by = windows.keyed(frame, ["k"])
    assert (by.large is None) == (block_rows > 300)
    got = windows.running_totals(by, ["d", "o"], {"total": F.col("v"), "place": F.lit(1)}).collect()
    expected = {}
    for key in ("big", "small"):
        total = None
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        for place, (_, _, order, value) in enumerate(mine, start=1):
            total = total if value is None else (total or 0.0) + value
            expected[key, order] = (total, place)
    assert {(r["k"], r["o"]): (r["total"], r["place"]) for r in got} == expected


def test_previous_value_crosses_blocks(spark, block_rows):
    frame = spark.range(1, 200).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 5 != 0, F.col("id")).alias("v"))
    got = windows.previous_value(windows.keyed(frame, ["k"]), ["id"], "v", "before").collect()
    assert {r["id"]: r["before"] for r in got} == {
        i: (None if i == 1 or (i - 1) % 5 == 0 else i - 1) for i in range(1, 200)
    }


def test_a_dominant_key_with_far_apart_order_values(spark, monkeypatch):
    """Two thirds of the rows have one key, ordered by random 64-bit numbers, some of them missing."""
    monkeypatch.setattr(windows, "BLOCK_ROWS", 1000)
    frame = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 > 0 THEN 0 ELSE id + 1 END AS k", "CASE WHEN id % 1000 = 1 THEN NULL ELSE xxhash64(id) END AS o", "id", "id AS v"
    )
    by = windows.keyed(frame, ["k"])
    (row,) = by.large.collect()
    assert row["k"] == 0 and row["__blocks"] >= 2
    got = [r for r in windows.previous_value(by, ["o", "id"], "v", "before").collect() if r["k"] == 0]
    mine = sorted(got, key=lambda r: (r["o"] is None, r["o"] or 0, r["id"]))
    assert [r["before"] for r in mine] == [None, *[r["v"] for r in mine[:-1]]]
    ranked = windows.running_totals(by, ["o", "id"], {"rank": F.lit(1)}).collect()
    assert sorted(r["rank"] for r in ranked if r["k"] == 0) == list(range(1, 20_001))
    borders = windows._borders(by, ["o", "id"])
    sizes = windows._in_blocks(by, by.rows, borders, ["o", "id"], "inner").groupBy("__block").count().collect()
    assert len(sizes) == row["__blocks"] and max(r["count"] for r in sizes) < 2 * min(r["count"] for r in sizes)


def test_a_million_equal_times_of_one_start(spark):
    laps = spark.range(1_000_000).selectExpr(
        "1 AS raceId", "1 AS driverId", "int(id) AS lap", "int(id % 20) AS position", "90000 AS milliseconds", "'1:30' AS time"
    )
    by = windows.keyed(laps, ["raceId", "driverId"], store=False)
    assert by.large.first()["__blocks"] == by.tasks
    borders = windows._borders(by, ["milliseconds", "lap"])
    sizes = windows._in_blocks(by, by.rows, borders, ["milliseconds", "lap"], "inner").groupBy("__block").count().collect()
    assert len(sizes) == by.tasks and max(r["count"] for r in sizes) < 2 * 1_000_000 / by.tasks
    wrong = drilldown.lap_analysis(laps).filter(
        "fastest_lap_rank != lap + 1 OR NOT (prev_position <=> CASE WHEN lap > 0 THEN (lap - 1) % 20 END)"
    )
    assert wrong.count() == 0


def test_running_totals_of_doubles_with_a_dominant_key(spark, block_rows):
    """A third of all rows has one key; totals stay within the stated rounding of an exact sum."""
    frame = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS o", "exp(sin(id) * 20) AS v"
    )
    rows = windows.running_totals(windows.keyed(frame, ["k"]), ["o"], {"total": F.col("v")}).collect()
    mine = sorted((row["o"], row["v"], row["total"]) for row in rows if row["k"] == 0)
    assert len(rows) == 30_000 and len(mine) == 10_000
    exact = []
    for _, value, total in mine:
        exact.append(value)
        if len(exact) % 997 == 0:
            assert total == pytest.approx(math.fsum(exact), rel=len(exact) * 2**-53)


def test_intermediates_can_be_removed(spark):
    from pathlib import Path

    from tablewright.session import run_folder
    from tablewright.sources.intermediates import remove_intermediates, stored

    assert stored(spark.range(3), "three").count() == 3
    assert Path(run_folder(spark)).exists()
    remove_intermediates(spark)
    assert not Path(run_folder(spark)).exists()


@pytest.mark.parametrize("limit", [0, 10_000])
def test_group_facts_meet_every_row(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "GROUPS", limit)
    few = joins.few_values(spark.range(4), "id")
    assert few == (limit > 0)
    rows = spark.range(1000).select((F.col("id") % 4).alias("k"), "id")
    joined = joins.join_groups(rows, rows.groupBy("k").agg(F.count("*").alias("n")), "k", few)
    assert joined.count() == 1000 and {r["n"] for r in joined.collect()} == {250}


def test_a_dominant_key_is_split(spark):
    """With broadcasting off and small thresholds, adaptive execution splits the dominant key."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 200_000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), "id"
        )
        facts = rows.groupBy("k").agg(F.count("*").alias("n"))
        joined = joins.join_splittable(rows, facts, ["k"]).groupBy("n").agg(F.count("*").alias("rows"))
        got = {row["n"]: row["rows"] for row in joined.collect()}
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(got.values()) == 200_000
    assert max(got) > 60_000 and got[max(got)] == max(got)
    assert "SortMergeJoin(skew=true)" in text


def test_cards(spark):
    frame = spark.createDataFrame([(3, None)], "total_wins INT, media_custo DOUBLE")
    assert [tuple(row) for row in reshape.cards(frame).collect()] == [(1, "Total Wins", 3.0), (2, "Media Custo", None)]


def test_expressions(spark):
    row = (
        spark.range(1)
        .select(
            numbers.leading_digit(F.lit(12)).alias("a"),
            numbers.leading_digit(F.lit(9)).alias("b"),
            numbers.change_rate(F.lit(1.0), F.lit(0.0)).alias("c"),
            numbers.direction(F.lit(None).cast("double")).alias("d"),
            numbers.direction(F.lit(0.0)).alias("e"),
            text.card_label(F.lit("qualifying_vs_race")).alias("f"),
            dates.completed_months(F.lit(date(2020, 1, 31)), F.lit(date(2020, 2, 29))).alias("g"),
            dates.completed_months(F.lit(date(2020, 1, 15)), F.lit(date(2020, 2, 15))).alias("h"),
            dates.parse_moment(F.lit("nonsense")).alias("i"),
            dates.long_date(F.lit(date(1999, 3, 7))).alias("j"),
            numbers.text_to_float(F.lit("1:02.1")).alias("k"),
        )
        .first()
    )
    assert tuple(row) == (1, 0, None, "decrease", "decrease", "Qualifying Vs Race", 0, 1, None, "March 07, 1999", None)


def test_nan_becomes_null(spark):
    frame = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "`a b` DOUBLE, n INT")
    assert [row[0] for row in numbers.nan_to_null(frame).orderBy("n").collect()] == [None, 2.0]


def test_csv_folder(spark, tmp_path):
    (tmp_path / "drivers.csv").write_text("driverId,forename\n1,Ann\n2,\\N\n")
    (tmp_path / "notes.txt").write_text("not a table\n")
    files.write_csv(spark.createDataFrame([(1, 2.5), (2, None)], "id INT, x DOUBLE").repartition(2), str(tmp_path / "parts.v2.csv"))
    tables = files.register_csv_folder(spark, str(tmp_path), {"drivers": "driverId INT, forename STRING"})
    assert sorted(tables) == ["drivers", "parts"]
    (tmp_path / "archive.csv").mkdir()
    (tmp_path / "archive.csv" / "deep").mkdir()
    for inner in ("old", "archive.csv/deep"):
        (tmp_path / inner).mkdir(exist_ok=True)
        (tmp_path / inner / "drivers.csv").write_text("x\n1\n")
    assert sorted(files.csv_tables(spark, str(tmp_path))) == ["drivers", "parts"]
    assert [tuple(r) for r in spark.table("drivers").orderBy("driverId").collect()] == [(1, "Ann"), (2, None)]
    assert sorted(((r["id"], r["x"]) for r in spark.table("parts").collect())) == [(1, 2.5), (2, None)]
    (tmp_path / "drivers.csv").write_text("driverId,forename\n9,Zoe\n")
    files.register_csv_folder(spark, str(tmp_path))
    assert [tuple(r) for r in spark.table("drivers").collect()] == [(9, "Zoe")]
    profile = {(r["table_name"], r["column_name"]): r["data_type"] for r in files.schema_profile(spark, str(tmp_path)).collect()}
    assert profile == {
        ("drivers", "driverId"): "int",
        ("drivers", "forename"): "string",
        ("parts", "id"): "int",
        ("parts", "x"): "double",
    }


def test_rank_with_null_marker_stays_a_number(spark, tmp_path):
    (tmp_path / "results.csv").write_text("raceId,rank\n1,1\n2,\\N\n")
    frame = files.read_csv(spark, str(tmp_path / "results.csv"))
    assert dict(frame.dtypes)["rank"] == "int"
    assert frame.filter("rank = 1").count() == 1


def test_parquet_and_options(spark):
    frame = spark.createDataFrame([(2,), (1,), (2,)], "id_procedimento INT")
    stored = options.save_options(frame, "id_procedimento", shared_folder(spark, "options"))
    assert options.option_values(options.option_list(stored, "id_procedimento")) == ["1", "2"]
    with pytest.raises(ValueError):
        options.option_values(stored, limit=1)


def test_preview_and_pages(spark):
    frame = spark.range(100)
    first = [r["id"] for r in preview.random_rows(frame, "id", 5, seed=3).collect()]
    again = [r["id"] for r in preview.random_rows(frame.repartition(7), "id", 5, seed=3).collect()]
    assert first == again and len(set(first)) == 5
    assert [r["id"] for r in preview.page(frame, ["id"], 20, 3).collect()] == [20, 21, 22]


def test_pages_by_cursor(spark):
    rows = [(None if i % 10 == 9 else i % 5, i) for i in range(60)]
    frame = spark.createDataFrame(rows, "k INT, id INT")
    seen, last = [], None
    for _ in range(8):
        got = [tuple(row) for row in preview.page_after(frame, ["k", "id"], last, 8).collect()]
        seen += got
        last = got[-1]
    assert seen == sorted(rows, key=lambda row: (row[0] is None, row[0] or 0, row[1]))
    assert preview.page_after(frame, ["k", "id"], last, 8).collect() == []


def test_one_level_of_a_folder_is_listed(spark, tmp_path):
    """A folder that nobody may read does not stand in the way of the tables beside it."""
    (tmp_path / "a.csv").write_text("x\n1\n")
    deep = tmp_path / "other"
    for _ in range(30):
        deep = deep / "d"
    deep.mkdir(parents=True)
    (deep / "b.csv").write_text("x\n1\n")
    listed = []
    real = spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path)).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    before = real.getStatistics(real.getUri().getScheme(), real.getClass()).getReadOps()
    assert list(files.csv_tables(spark, str(tmp_path))) == ["a"]
    listed.append(real.getStatistics(real.getUri().getScheme(), real.getClass()).getReadOps() - before)
    assert listed[0] <= 2


def test_types_join_in_a_lattice(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'i,l,d,s,b,day,ts,mixed,none,"quoted, name",q\n'
        '1,3000000000,1.5,x,true,2020-01-01,2020-01-01 10:00:00,1,,"a, b",1\n'
        "\n"
        '-2,4,2,7,FALSE,2020-02-30x,2020-01-01,true,\\N,"say ""hi""",2,extra,more\n'
        '3,5,1e3,2020-01-01,true,2020-01-02,2021-01-01T00:00:00,2.5,,c\n'
    )
    (tmp_path / "only.csv").write_text("a,b\n")
    (tmp_path / "blank.csv").write_text("")
    got = {(r["table_name"], r["position"]): (r["column_name"], r["data_type"]) for r in files.schema_profile(spark, str(tmp_path)).collect()}
    kinds = "int bigint double string boolean string timestamp string string string int".split()
    names = ["i", "l", "d", "s", "b", "day", "ts", "mixed", "none", "quoted, name", "q"]
    assert got == {("t", i + 1): pair for i, pair in enumerate(zip(names, kinds))} | {("only", 1): ("a", "string"), ("only", 2): ("b", "string")}
    plain = spark.read.options(header=True, inferSchema=True, nullValue="\\N").csv(str(tmp_path / "t.csv")).dtypes
    assert [kind for _, kind in plain] == kinds


def test_one_job_for_fifty_files(spark, tmp_path):
    for i in range(50):
        (tmp_path / f"t{i}.csv").write_text("a,b\n" + "".join(f"{j},{j / 4}\n" for j in range(5)))
    spark.sparkContext.setJobGroup("profile", "profile")
    frame = files.schema_profile(spark, str(tmp_path))
    # Spark itself may list over 32 files in a job of its own; nothing is read before the result is asked for.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("profile")) <= 1
    rows = frame.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == 100 and {(r["column_name"], r["data_type"]) for r in rows} == {("a", "int"), ("b", "double")}
    assert frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan text") == 1


@pytest.mark.parametrize("rows", [0, 1, 5000])
def test_id_filter_lets_every_id_pass(spark, rows):
    ids = spark.range(rows).selectExpr("id * 7 AS id")
    might_hold = joins.id_filter(ids, "id", rows)
    passed = spark.range(70_000).filter(might_hold(F.col("id")))
    assert passed.join(ids, "id", "left_semi").count() == rows
    assert passed.count() <= rows + 70_000 * 0.01
    assert joins.id_filter(ids, "id", 10**9) is None


def test_json_records(spark, tmp_path):
    (tmp_path / "movies.json").write_text('{"Title": "A", "US_Gross": 5}\n{"Title": "B"}\n')
    rows = files.read_records(spark, str(tmp_path / "movies.json"), "Title STRING, US_Gross DOUBLE").collect()
    assert sorted((r["Title"], r["US_Gross"]) for r in rows) == [("A", 5.0), ("B", None)]


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(root)
