"""

Each query runs an analysis or operator over whole given tables, dressed by
``tablewright.standins``.  ``flat`` only makes results comparable across engines: whole numbers
become BIGINT, fractions are rounded, dates and arrays become text.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import check_sql  # noqa: E402
from tablewright.functions import dates, numbers, text  # noqa: E402
from tablewright.operators import filters  # noqa: E402
from tablewright.plans import ambulatory, cards, career, creatures, drilldown, hospital, releases, snapshot  # noqa: E402
from tablewright.session import shared_folder  # noqa: E402
from tablewright.sources import catalog, files, options, preview  # noqa: E402
from tablewright.standins import Tables  # noqa: E402

CIDS = ("3", "17", "42", "58", "77")
PROCEDURES = ("1", "5", "9", "13", "20")
CARE_CIDS = ("1-URGENT", "3-MEDIUM")
CARE_PROCEDURES = ("0", "3")
PERIOD = (datetime(1998, 3, 1), datetime(1999, 3, 1))
BRUSH = {"Production_Budget": (20000.0, 60000.0), "IMDB_Rating": (3.0, 8.0)}
NOT_REASONS = ("ASIA", "EUROPE")
INCIDENTS = ("AFR", "EAST")
RELATIVE = ("density",)
WHOLE = ("tinyint", "smallint", "int", "bigint")


def flat(frame: DataFrame) -> DataFrame:
    forms = {"double": "round({0}, 6)", "float": "round(cast({0} AS double), 6)"}
    forms |= dict.fromkeys(WHOLE, "cast({0} AS bigint)")
    forms |= dict.fromkeys(("date", "timestamp", "timestamp_ntz"), "date_format({0}, 'yyyy-MM-dd HH:mm:ss')")
    columns = []
    for name, kind in frame.dtypes:
        form = "array_join(cast({0} AS array<string>), ',', '-')" if kind.startswith("array") else forms.get(kind, "{0}")
        form = "format_string('%.6e', {0})" if name in RELATIVE else form
        columns.append(f"{form.format(f'`{name}`')} AS `{name}`")
    return frame.selectExpr(*columns)


def _racing(analysis: Callable, *tables: str, **choices) -> Callable[[SparkSession, str], DataFrame]:
    """A career analysis over the named stand-in tables."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        given = Tables(spark, folder)
        return analysis(*[getattr(given, table)() for table in tables], **choices)

    return run


def _query(body: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: body(Tables(spark, folder))


def _csv_folder(given: Tables) -> DataFrame:
    folder = shared_folder(given.spark, "csv")
    for name in ("supplier", "nation"):
        files.write_csv(given[name], f"{folder}/{name}.csv")
    files.write_csv(given["region"], f"{folder}/archive/supplier.csv")
    schemas = {
        "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
        "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    }
    tables = files.register_csv_folder(given.spark, folder, schemas)
    return (
        tables["supplier"]
        .join(tables["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("suppliers"), F.sum("s_acctbal").alias("balance"))
    )


def _encoded_csv(given: Tables) -> DataFrame:
    labels = given["part"].selectExpr("p_partkey", "concat_ws(' ', p_name, 'né à Ñuñoa, Größe', p_size) AS label")
    path = files.write_csv(labels, f"{shared_folder(given.spark, 'latin')}/labels.csv", "ISO-8859-1")
    return files.read_csv(given.spark, path, "p_partkey BIGINT, label STRING", encoding="ISO-8859-1")


def _json_records(given: Tables) -> DataFrame:
    rows = given["customer"].selectExpr("c_custkey", "c_name", "CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal")
    path = files.write_records(rows, shared_folder(given.spark, "records"))
    return files.read_records(given.spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")


def _partitioned_lake(given: Tables) -> hospital.Lake:
    """The hospital tables with admissions stored in one folder per year."""
    lake, folder = given.hospital(), shared_folder(given.spark, "admissions")
    lake.admissions.write.partitionBy("partition_0").parquet(folder)
    return replace(lake, admissions=given.spark.read.schema(lake.admissions.schema).parquet(folder))


def _schema_profile(given: Tables) -> DataFrame:
    folder = shared_folder(given.spark, "profile")
    for name in ("customer", "supplier", "nation"):
        files.write_csv(given[name], f"{folder}/{name}.csv")
    return files.schema_profile(given.spark, folder)


def _parquet_sink(given: Tables) -> DataFrame:
    frame = given["orders"].groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("total"))
    return files.read_parquet(given.spark, files.write_parquet(frame, shared_folder(given.spark, "totals")))


def _option_snapshot(given: Tables) -> DataFrame:
    return options.save_options(given["part"], "p_partkey", shared_folder(given.spark, "options"))


def _sql_over_tables(given: Tables) -> DataFrame:
    statement = """
        SELECT n_name, count(*) AS customers, sum(c_acctbal) AS balance
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        WHERE (:segment IS NULL OR c_mktsegment = :segment) AND (:region IS NULL OR n_regionkey = :region)
        GROUP BY n_name
    """
    choices = {"segment": "BUILDING", "region": None}
    return catalog.query(given.spark, statement, choices, customer=given["customer"], nation=given["nation"])


def _frame_in_sql(given: Tables) -> DataFrame:
    statement = "SELECT * FROM {df} WHERE array_contains(:cid, cid)"
    df = given["customer"].select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("cid"))
    return catalog.query(given.spark, statement, {"cid": F.array(F.lit("BUILDING"), F.lit("MACHINERY"))}, df=df)


def _inline_records(given: Tables) -> DataFrame:
    rows = [{"segment": "BUILDING", "label": "B"}, {"segment": "FURNITURE", "label": "F"}]
    labels = catalog.records(given.spark, rows, "segment STRING, label STRING")
    customers = given["customer"].select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return customers.join(labels, "segment").groupBy("label").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("top"))


def _parsed_dates(given: Tables) -> DataFrame:
    written = dates.iso_date(F.col("o_orderdate"))
    written = F.when(F.col("o_orderstatus") == "P", F.lit("unknown")).otherwise(written)
    return given["orders"].select("o_orderkey", dates.parse_moment(written, "yyyy-MM-dd").alias("parsed"))


def _date_functions(given: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    born = F.make_date(F.lit(1960), (F.col("o_custkey") % 12 + 1).cast("int"), (F.col("o_custkey") % 28 + 1).cast("int"))
    return given["orders"].select(
        "o_orderkey",
        F.year(day).alias("year"),
        dates.month_start(day).alias("month"),
        dates.completed_months(born, day).alias("months"),
        dates.days_back(day, 45).alias("back"),
        dates.decade_start(dates.decade_of(day)).alias("decade_from"),
        dates.decade_end(dates.decade_of(day)).alias("decade_to"),
        dates.long_date(day).alias("spelled"),
    )


def _number_functions(given: Tables) -> DataFrame:
    return given["orders"].select(
        "o_orderkey",
        numbers.bubble_size(F.col("o_totalprice")).alias("size"),
        numbers.leading_digit((F.col("o_custkey") % 60 + 11).cast("int")).alias("digit"),
        numbers.text_to_float(
            F.concat_ws("", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", F.lit(":")))
        ).alias("number"),
        numbers.change_rate(F.col("o_totalprice"), F.log1p("o_custkey")).alias("rate"),
        numbers.direction(numbers.change_rate(F.col("o_totalprice"), F.col("o_custkey") * 300)).alias("direction"),
    )


def _text_functions(given: Tables) -> DataFrame:
    return given["part"].select(
        "p_partkey",
        text.full_name("p_brand", "p_type").alias("joined"),
        text.card_label(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("label"),
        text.contains_any(F.col("p_name"), ("ring", "bolt")).alias("has_part").cast("int").alias("has_part"),
        text.first_character(F.col("p_type")).alias("initial"),
    )


def _commented_predicates(given: Tables) -> DataFrame:
    """Season range on venues and first-character filter on a code."""
    rows = given["orders"].filter(text.first_character(F.col("o_custkey")).isin("1", "4", "5", "6"))
    rows = filters.within(rows.withColumn("year", F.year("o_orderdate")), "year", 1996, 1998)
    return rows.select("o_orderkey", "year")


def _chosen_keys(given: Tables) -> DataFrame:
    """Orders of the customers in a key frame, and the distinct keys behind it."""
    rich = given["customer"].filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("o_custkey"))
    return filters.matching_keys(given["orders"], rich, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


DRILL = ("stage_results", "stage_races", "stage_constructors", "status", "stage_qualifying", "laps", "pit_stops")


def _lake(analysis: Callable, **choices) -> Callable[[SparkSession, str], DataFrame]:
    return _query(lambda given: analysis(given.hospital(), **choices))


def _care(analysis: Callable, *tables: str, chosen: tuple = CARE_PROCEDURES) -> Callable[[SparkSession, str], DataFrame]:
    def run(given: Tables) -> DataFrame:
        frames = [getattr(given, table)() for table in ("watermarks", "care", "care_diagnoses", "care_procedures", *tables)]
        return analysis(*frames, cids=CARE_CIDS, chosen=chosen, years=3)

    return _query(run)


def _age_bands(given: Tables) -> DataFrame:
    care = ambulatory.care_of_interest(given.care(), given.care_diagnoses(), given.care_procedures(), CARE_CIDS, CARE_PROCEDURES)
    return ambulatory.age_bands(ambulatory.diagnosis_dates(care), given.birth_dates(), given.age_bands())


def entry(spark: SparkSession) -> DataFrame:
    """Season points per supplier, year and brand at the smallest scale."""
    return queries()["q05_season_points"](spark, "/root/testdata/sf0.001")


def analyses() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query in the types its analysis returns."""
    star = ("results", "races", "constructors")
    absent = -1
    return {
        # career
        "q01_driver_options": _racing(career.driver_options, "drivers"),
        "q02_driver_id_of": _racing(career.driver_id_of, "drivers", driver_name="Supplier 000000007"),
        "q03_constructor_options": _racing(career.constructor_options, "results", "constructors"),
        "q04_constructor_id_of": _query(
            lambda t: career.constructor_id_of(career.constructor_options(t.results(), t.constructors(), 7), "Brand#11")
        ),
        "q05_season_points": _racing(career.season_points, *star),
        "q05_season_points_one_driver": _racing(career.season_points, *star, driver_id=7, constructor_id=None),
        "q06_race_points": _racing(career.race_points, *star),
        "q07_career_scorecard": _racing(career.career_scorecard, "results", "races"),
        "q07_scorecard_absent_driver": _racing(career.career_scorecard, "results", "races", driver_id=absent),
        "q08_selected_season": _query(
            lambda t: career.selected_season(career.season_points(t.results(), t.races(), t.constructors()), 7)
        ),
        "q09_season_progression": _racing(
            career.season_progression, *star, tie_break=("constructorId", "positionOrder")
        ),
        "q10_podium_split": _racing(career.podium_split, "results", "races"),
        "q11_non_finish_reasons": _racing(
            career.non_finish_reasons, "results", "races", "status", finished=NOT_REASONS
        ),
        "q11_reasons_one_season": _racing(
            career.non_finish_reasons, "results", "races", "status", driver_id=7, year=1998, finished=NOT_REASONS
        ),
        "q12_qualifying_vs_race": _racing(drilldown.qualifying_vs_race, "results", "qualifying", "races"),
        "q13_venues": _racing(career.venues, "results", "races", "circuits"),
        "q13_venues_between_years": _racing(
            career.venues, "results", "races", "circuits", start_year=1996, end_year=1997
        ),
        "q14_race_drilldown": _racing(drilldown.race_drilldown, *DRILL, incidents=INCIDENTS),
        "q14_race_scorecard": _racing(drilldown.race_scorecard, *DRILL, incidents=INCIDENTS),
        "q14_lap_analysis": _racing(drilldown.lap_analysis, "laps"),
        "q14_pit_summary": _racing(drilldown.pit_summary, "pit_stops"),
        # snapshot
        "q15_year_snapshot": _racing(snapshot.year_snapshot, "country_years", year=1998),
        "q15_all_years": _racing(snapshot.year_snapshot, "country_years"),
        "q16_axis_bounds": _racing(snapshot.axis_bounds, "country_years"),
        "q17_years": _racing(snapshot.years, "country_years"),
        "q17_default_year": _racing(snapshot.default_year, "country_years"),
        "q17_next_years": _racing(snapshot.next_years, "country_years"),
        # releases
        "q18_period_rows": _query(
            lambda t: releases.period_rows(t.movies(), *PERIOD).select("Title", "Release_Date", "period")
        ),
        "q19_period_cards": _query(lambda t: releases.period_cards(t.movies(), *PERIOD)),
        "q20_brushed_cards": _racing(releases.brushed_cards, "movies", ranges=BRUSH),
        "q21_genre_counts": _racing(releases.genre_counts, "movies"),
        "q22_scatter_rows": _query(lambda t: releases.scatter_rows(t.movies(), *PERIOD)),
        "q23_decade_rows": _query(
            lambda t: releases.decade_rows(t.movies(), (1980, 1990, 2000)).select(
                "Title", "Release_Date", "decade", "decade_start", "decade_end"
            )
        ),
        # creatures
        "q24_type_counts": _racing(creatures.type_counts, "creatures"),
        "q25_of_types": _racing(creatures.of_types, "creatures", types=["PROMO", "SMALL"]),
        "q25_of_types_with_all": _query(
            lambda t: creatures.cleaned(creatures.of_types(t.creatures(), ["PROMO", "All"])).select("#", "Name", "Type 1")
        ),
        "q26_attribute_histogram": _racing(creatures.attribute_histogram, "creatures", attribute="HP"),
        "q26_histogram_of_ratio": _racing(creatures.attribute_histogram, "creatures", attribute="Attack / Defense"),
        "q26_histogram_fixed_bins": _racing(creatures.attribute_histogram, "creatures", attribute="Attack", bins=10),
        "q26_attribute_density": _racing(creatures.attribute_density, "creatures", attribute="Speed"),
        "q26_histogram_of_lines": _racing(creatures.attribute_histogram, "priced_lines", attribute="HP"),
        "q26_density_of_lines": _racing(creatures.attribute_density, "priced_lines", attribute="HP"),
        "q27_radar": _racing(creatures.radar, "creatures"),
        # hospital
        "q28_admissions_count": _lake(hospital.admissions_count, cids=CIDS, procedures=PROCEDURES, years=3),
        "q28_any_procedure": _lake(hospital.admissions_count, cids=CIDS, years=3),
        "q28_no_diagnosis": _lake(hospital.admissions_count, cids=(), years=3),
        "q29_mean_cost": _lake(hospital.mean_cost, cids=CIDS, procedures=PROCEDURES, years=3),
        "q30_admissions_by_year": _lake(hospital.admissions_by_year, cids=CIDS, procedures=PROCEDURES, years=2),
        "q30_partitioned_admissions": _query(
            lambda t: hospital.admissions_by_year(_partitioned_lake(t), cids=CIDS, procedures=PROCEDURES, years=2)
        ),
        "q30_cohort_stays": _lake(hospital.cohort_stays, cids=CIDS, procedures=PROCEDURES, years=2),
        # ambulatory
        "q31_cohort_size": _care(ambulatory.cohort_size, "birth_dates", "age_bands"),
        "q31_cohort_size_any_procedure": _care(ambulatory.cohort_size, "birth_dates", "age_bands", chosen=()),
        "q31_age_bands": _query(_age_bands),
        "q32_patients_by_year": _care(ambulatory.patients_by_year),
        # cards and parameters
        "q33_stat_cards": _query(
            lambda t: cards.stat_cards(
                career.career_scorecard(t.results(), t.races(), driver_id=7).drop("driverId"),
                hospital.admissions_count(t.hospital(), CIDS, PROCEDURES, 3),
                hospital.mean_cost(t.hospital(), CIDS, PROCEDURES, 3),
            )
        ),
        "q34_parameter_rows": _query(
            lambda t: cards.parameter_rows(t["customer"], "c_mktsegment", ["BUILDING", "MACHINERY"])
        ),
        "q34_single_parameter": _query(lambda t: cards.parameter_rows(t["customer"], "c_mktsegment", "BUILDING")),
        "q34_missing_parameter": _query(lambda t: cards.parameter_rows(t["customer"], "c_mktsegment", None)),
        # sources and sinks
        "s01_csv_folder": _query(_csv_folder),
        "s02_schema_profile": _query(_schema_profile),
        "s04_encoded_csv": _query(_encoded_csv),
        "s07_json_records": _query(_json_records),
        "s06_sql_over_tables": _query(_sql_over_tables),
        "s08_inline_records": _query(_inline_records),
        "s09_frame_in_sql": _query(_frame_in_sql),
        "s10_parquet_sink": _query(_parquet_sink),
        "s11_option_snapshot": _query(_option_snapshot),
        "s12_random_rows": _query(lambda t: preview.random_rows(t["orders"], "o_orderkey", 5, seed=1)),
        "s13_page": _query(lambda t: preview.page(t["orders"], ["o_orderdate", "o_orderkey"], 20, 10)),
        "s13_page_after": _query(
            lambda t: preview.page_after(t["orders"], ["o_orderdate", "o_orderkey"], (datetime(1998, 3, 1), 500), 10)
        ),
        # filters and scalar functions
        "p06_parsed_dates": _query(_parsed_dates),
        "p07_option_list": _query(lambda t: options.option_list(t["orders"], "o_custkey")),
        "f09_excluding": _query(
            lambda t: filters.excluding(t["orders"], "o_orderpriority", ["5-LOW", "2-HIGH"]).select("o_orderkey")
        ),
        "f18_chosen_keys": _query(_chosen_keys),
        "f19_commented_predicates": _query(_commented_predicates),
        "c_date_functions": _query(_date_functions),
        "c_number_functions": _query(_number_functions),
        "c_text_functions": _query(_text_functions),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The same results in comparable types."""

    def comparable(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: flat(run(spark, folder))

    return {name: comparable(run) for name, run in analyses().items()} | _corpus_queries()


def oracle_sql() -> dict[str, str]:
    return check_sql.statements() | _corpus_sql()


def _corpus_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The text-corpus queries, where that subpackage and what it needs are installed."""
    try:
        import corpus_pipeline
        from tablewright.llm import queries as corpus
    except ImportError:
        return {}
    return corpus.QUERIES | {"pipeline": corpus_pipeline.run}


def _corpus_sql() -> dict[str, str]:
    try:
        from tablewright.llm import queries as corpus
    except ImportError:
        return {}
    return corpus.SQL
