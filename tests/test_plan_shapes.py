"""Plan shapes that decide whether a query holds at cluster scale.

Broadcasting by statistics is off here, so the plans are those of tables too large for it.
"""

from __future__ import annotations

import re

import __spark_entry__ as contract
import pytest
from tablewright.operators.filters import recent_partitions, recent_years
from tablewright.plans.hospital import watermark_year
from tablewright.session import shared_folder
from tablewright.sources import preview

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def big(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(contract.analyses()))
def test_no_cross_join_no_python(big, name):
    text = plan(contract.queries()[name](big, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"EvalPython|InPandas|BatchEval", text)


def test_cohort_is_shuffled_once_per_fact(big):
    text = plan(contract.queries()["q28_admissions_count"](big, FOLDER))
    text = text.split("===== Subqueries =====")[0]
    # by diagnosis, by procedure and by procedure code; the diagnosis codes have been met while the plan was built
    assert text.count("LeftSemi") == 3
    # admissions, diagnosis bridge and procedure bridge, each by admission id after a partial combine
    assert len(re.findall(r"Exchange hashpartitioning\(id_aih", text)) == 3
    # the chosen codes are broadcast, so no fact is shuffled by code
    assert not re.search(r"SortMergeJoin \[(cid|id_procedimento)#", text)
    # the Bloom filter stands below the shuffles of admissions and procedures
    assert len(re.findall(r"Filter [^\n]*getbit", text)) >= 2


@pytest.mark.parametrize("name", ["q28_admissions_count", "q29_mean_cost", "q30_admissions_by_year", "q30_cohort_stays"])
def test_small_bridges_are_broadcast_instead_of_filtered(spark, name):
    """The planner's estimate decides; both ways give the same rows."""
    small = contract.queries()[name](spark, FOLDER)
    assert "getbit" not in plan(small) and "BroadcastHashJoin" in plan(small)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = sorted(map(str, small.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = contract.queries()[name](spark, FOLDER)
        assert "getbit" in plan(large)
        assert sorted(map(str, large.collect())) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_page_by_cursor_reads_no_more_than_the_first(spark):
    folder = shared_folder(spark, "sorted")
    rows = spark.range(200_000, numPartitions=1).selectExpr("id", "id % 7 AS other")
    rows.write.option("parquet.block.size", 64 * 1024).option("parquet.page.row.count.limit", 5000).parquet(folder)
    table = spark.read.parquet(folder)
    first = records_scanned(preview.page_after(table, ["id"], None, 100))
    late = preview.page_after(table, ["id"], [99_900], 100)
    assert [row["id"] for row in late.collect()] == list(range(99_901, 100_001))
    assert records_scanned(preview.page_after(table, ["id"], [99_900], 100)) <= first
    assert records_scanned(preview.page_after(table, ["id"], [199_800], 100)) < 20_000


def test_first_event_needs_one_pass_over_care(big):
    text = plan(contract.queries()["q31_cohort_size"](big, FOLDER))
    assert len(re.findall(r"partial_min\(dt_atendimento#\d+\), partial_max\(dt_atendimento", text)) == 1


def test_windows_have_a_key(big):
    for name in ("q09_season_progression", "q14_lap_analysis", "q14_race_drilldown", "q21_genre_counts"):
        text = plan(contract.queries()[name](big, FOLDER))
        for window in re.findall(r"windowspecdefinition\(([^)]*)\)", text):
            assert "#" in window.split(" ASC")[0].split(",")[0]
        assert "SinglePartition" not in text


def test_raw_rows_of_few_groups_are_not_shuffled(big):
    for name in ("q26_density_of_lines", "q26_histogram_of_lines"):
        text = plan(contract.queries()[name](big, FOLDER))
        assert "BroadcastHashJoin" in text and "ShuffledHashJoin" not in text
        assert not re.search(r"Exchange[^\n]*\n[^\n]*\(\d+\) Filter[^\n]*\n[^\n]*Scan parquet", text)


def test_tables_are_aggregated_once_in_the_drill_down(big):
    text = plan(contract.queries()["q14_race_drilldown"](big, FOLDER))
    assert text.count("partial_collect_list") == 3 and text.count("FileScan parquet [event_id") <= 6


def test_scan_reads_only_what_is_needed(big):
    text = plan(contract.queries()["q07_career_scorecard"](big, FOLDER))
    schema = re.search(r"FileScan parquet \[(l_[^\]]*)\]", text).group(1)
    assert "l_shipdate" not in schema and "l_returnflag" not in schema


def test_literal_filters_reach_the_scan(big):
    text = plan(contract.queries()["q20_brushed_cards"](big, FOLDER))
    assert "GreaterThanOrEqual(l_extendedprice,20000.0)" in text
    text = plan(contract.queries()["q19_period_cards"](big, FOLDER))
    assert "GreaterThanOrEqual(l_shipdate" in text


def test_year_limits_prune(big):
    orders = big.read.parquet(f"{FOLDER}/orders.parquet").selectExpr(
        "o_orderkey", "o_orderdate", "cast(year(o_orderdate) as string) AS partition_0"
    )
    folder = shared_folder(big, "stays")
    orders.write.partitionBy("partition_0").parquet(folder)
    big.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        stays = big.read.parquet(folder)
    finally:
        big.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "true")
    marks = big.createDataFrame([("sihsus", "hospitalar", 2001)], "base_origem STRING, frente STRING, dt_max_ano INT")
    kept = stays.filter(recent_partitions(stays["partition_0"], watermark_year(marks), 1))
    text = plan(kept)
    assert re.search(r"PartitionFilters: \[[^\]]*partition_0", text)
    dated = stays.filter(recent_years(stays["o_orderdate"], watermark_year(marks), 1))
    assert kept.count() == dated.count() == stays.filter("year(o_orderdate) >= 2000").count()


def test_no_local_checkpoint_and_no_rdd():
    from pathlib import Path

    for path in Path(contract.__file__).parent.joinpath("tablewright").rglob("*.py"):
        body = path.read_text()
        assert "localCheckpoint" not in body
        assert ".rdd" not in body


def records_scanned(frame):
    frame.collect()
    read = re.compile(r"number of output rows: ([\d,]+)")
    plan = frame._jdf.queryExecution().executedPlan()
    found, waiting = 0, [plan]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            waiting.append(node.plan())
        children = node.children()
        waiting.extend(children.apply(i) for i in range(children.size()))
    return found


def test_a_date_limit_prunes_row_groups(spark):
    """Dates sorted in the file, several row groups: the bound from the watermark skips most of them."""
    folder = shared_folder(spark, "dated")
    days = spark.range(150_000, numPartitions=1).selectExpr("id", "date_add(DATE '1992-01-01', int(id div 55)) AS day")
    days.write.option("parquet.block.size", 64 * 1024).option("parquet.page.row.count.limit", 5000).parquet(folder)
    marks = spark.createDataFrame([("sihsus", "hospitalar", 1999)], "base_origem STRING, frente STRING, dt_max_ano INT")
    stored = spark.read.parquet(folder)
    kept = stored.filter(recent_years(stored["day"], watermark_year(marks), 1))
    wanted = stored.filter("day >= DATE '1998-01-01'").count()
    assert kept.count() == wanted
    assert records_scanned(kept) < wanted + 20_000


def test_partitions_are_pruned_in_the_registered_query(big):
    text = plan(contract.queries()["q30_partitioned_admissions"](big, FOLDER))
    assert re.search(r"PartitionFilters: \[[^\]]*partition_0", text)
