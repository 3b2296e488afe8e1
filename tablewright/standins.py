"""The driver's star schema dressed as the tables the analyses expect.

Every frame is a lazy projection, join or aggregate of the given Parquet tables, so an
analysis over them does work that grows with those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.plans.hospital import Lake


SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


class Tables:
    """Given tables by name, and the role each plays."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    # racing: supplier = driver, part = constructor, order = race, line = result

    def drivers(self) -> DataFrame:
        return self["supplier"].selectExpr(
            "s_suppkey AS driverId", "split(s_name, '#')[0] AS forename", "split(s_name, '#')[1] AS surname"
        )

    def constructors(self) -> DataFrame:
        return self["part"].selectExpr("p_partkey AS constructorId", "p_brand AS name")

    def races(self) -> DataFrame:
        return self["orders"].selectExpr(
            "o_orderkey AS raceId",
            "year(o_orderdate) AS year",
            "o_custkey AS circuitId",
            "o_orderpriority AS name",
            "cast(o_orderdate AS date) AS date",
        )

    def circuits(self) -> DataFrame:
        return (
            self["customer"]
            .join(self["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
            .selectExpr("c_custkey AS circuitId", "c_name AS name", "n_name AS country")
        )

    def status(self) -> DataFrame:
        return self["region"].selectExpr("r_regionkey AS statusId", "r_name AS status")

    def results(self) -> DataFrame:
        return self["lineitem"].selectExpr(
            "l_orderkey AS raceId",
            "l_suppkey AS driverId",
            "l_partkey AS constructorId",
            "l_linenumber % 5 AS statusId",
            "l_extendedprice AS points",
            "l_linenumber AS positionOrder",
            "cast(l_quantity AS int) AS grid",
            "cast(round(l_discount * 100) AS int) AS rank",
        )

    def qualifying(self) -> DataFrame:
        return self["lineitem"].selectExpr(
            "l_orderkey AS raceId", "l_suppkey AS driverId", "cast(l_quantity AS int) AS position"
        )

    # drill-down: 2000 events = race, one of 50 groups of users = driver, event = lap or pit stop

    def _events(self) -> DataFrame:
        return self["events"].selectExpr(
            "event_id div 2000 AS raceId",
            "user_id % 50 AS driverId",
            "event_id",
            "ts",
            "event_type",
            "cast(round(value * 100) AS bigint) AS cents",
        )

    def stage_races(self) -> DataFrame:
        return (
            self._events()
            .groupBy("raceId")
            .agg(F.min("ts").alias("ts"))
            .selectExpr("raceId", "concat('Stage ', raceId) AS name", "cast(ts AS date) AS date")
        )

    def stage_results(self) -> DataFrame:
        return (
            self._events()
            .groupBy("raceId", "driverId")
            .agg(F.count("*").alias("laps"), F.sum("cents").alias("cents"), F.max("cents").alias("best"))
            .selectExpr(
                "raceId",
                "driverId",
                "cast(driverId % 25 AS int) AS constructorId",
                "cast(cents % 5 AS int) AS statusId",
                "cast(cents % 26 AS int) AS points",
                "cast(cents % 20 + 1 AS int) AS positionOrder",
                "cast(best % 20 + 1 AS int) AS grid",
                "laps",
                "cast(cents AS string) AS time",
                "cast(best AS string) AS fastestLapTime",
                "best / 100 AS fastestLapSpeed",
            )
        )

    def stage_constructors(self) -> DataFrame:
        return self["nation"].selectExpr("n_nationkey AS constructorId", "n_name AS name")

    def stage_qualifying(self) -> DataFrame:
        return (
            self._events()
            .filter("event_type = 'signup'")
            .groupBy("raceId", "driverId")
            .agg(F.min("cents").alias("low"), F.max("cents").alias("high"))
            .selectExpr(
                "raceId",
                "driverId",
                "cast(low % 20 + 1 AS int) AS position",
                "cast(low AS string) AS q1",
                "cast(high AS string) AS q2",
                "cast(NULL AS string) AS q3",
            )
        )

    def _numbered(self) -> DataFrame:
        number = "row_number() OVER (PARTITION BY raceId, driverId ORDER BY ts, event_id) AS lap"
        return self._events().selectExpr("*", number)

    def laps(self) -> DataFrame:
        return self._numbered().selectExpr(
            "raceId",
            "driverId",
            "lap",
            "CASE WHEN event_type <> 'error' THEN cast(cents % 20 + 1 AS int) END AS position",
            "event_type AS time",
            "cents AS milliseconds",
        )

    def pit_stops(self) -> DataFrame:
        return (
            self._numbered()
            .filter("event_type = 'purchase'")
            .selectExpr(
                "raceId",
                "driverId",
                "lap",
                "1 AS stop",
                "concat(CASE WHEN cents > 10000 THEN '1:' ELSE '' END, cents % 60) AS duration",
            )
        )

    # releases: line = movie

    def movies(self) -> DataFrame:
        return self["lineitem"].selectExpr(
            "concat_ws('-', l_orderkey, l_partkey, l_suppkey) AS Title",
            "l_returnflag AS Major_Genre",
            "l_shipdate AS Release_Date",
            "l_extendedprice AS Production_Budget",
            "l_extendedprice * (1 + l_tax) AS Worldwide_Gross",
            "l_extendedprice * (1 - l_discount) AS US_Gross",
            "l_quantity / 5 AS IMDB_Rating",
            "l_linenumber * 20D AS Running_Time_min",
        )

    # snapshot: order = country in a year

    def country_years(self) -> DataFrame:
        return self["orders"].selectExpr(
            "o_orderkey AS country",
            "o_orderpriority AS continent",
            "year(o_orderdate) AS year",
            "o_custkey % 60 + 25.5D AS lifeExp",
            "o_totalprice / 25 AS gdpPercap",
            "o_totalprice * 100 AS pop",
        )

    # creatures: part = creature

    def creatures(self) -> DataFrame:
        priced = self["part"].selectExpr("*", "cast(round(p_retailprice * 10) AS int) AS c")
        return priced.selectExpr(
            "p_partkey AS `#`",
            "concat_ws(' ', p_name, p_partkey) AS Name",
            "p_type AS `Type 1`",
            "p_size AS HP",
            "c % 191 AS Attack",
            "c % 53 AS Defense",
            "p_size * 3 AS `Sp. Atk`",
            "c % 71 AS `Sp. Def`",
            "p_size + c % 7 AS Speed",
            "1 AS Generation",
            "'False' AS Legendary",
        )

    def priced_lines(self) -> DataFrame:
        """Lines as creatures: return flag as type, price as HP, for a large continuous attribute."""
        return self["lineitem"].selectExpr("l_returnflag AS `Type 1`", "l_extendedprice AS HP")

    # hospital: two orders = one admission, line = diagnosis and procedure

    def watermarks(self) -> DataFrame:
        last = self["orders"].agg(F.max("o_orderdate").alias("last"))
        return last.selectExpr(
            "inline(array(named_struct('base_origem', 'sihsus', 'frente', 'hospitalar'), "
            "named_struct('base_origem', 'siasus', 'frente', 'ambulatorial')))",
            "year(last) AS dt_max_ano",
        )

    def hospital(self) -> Lake:
        lines = self["lineitem"]
        admissions = self["orders"].selectExpr(
            "cast(o_orderkey div 2 AS string) AS id_aih",
            "o_orderdate AS dt_entrada_internacao",
            "cast(o_custkey % 60 + 11 AS int) AS id_motivo_saida_permanencia",
            "o_totalprice AS vl_total_aih",
            "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS ind_obito",
            "cast(year(o_orderdate) AS string) AS partition_0",
        )
        stay = "cast(l_orderkey div 2 AS string) AS id_aih"
        return Lake(
            watermarks=self.watermarks(),
            admissions=admissions,
            diagnosis_bridge=lines.selectExpr(stay, "cast(l_suppkey AS string) AS cid"),
            procedure_bridge=lines.selectExpr(stay, "cast(l_partkey % 25 AS string) AS id_procedimento"),
            diagnoses=self["supplier"].selectExpr("cast(s_suppkey AS string) AS id_cid"),
            procedures=self["nation"].selectExpr("cast(n_nationkey AS string) AS id_procedimento"),
        )

    # ambulatory: customer = patient, order = care

    def care(self) -> DataFrame:
        return self["orders"].selectExpr(
            "cast(o_custkey AS string) AS id_cns_paciente",
            "o_orderpriority AS id_cid_principal",
            "cast(o_orderkey % 5 AS string) AS id_procedimento_principal",
            "o_orderdate AS dt_atendimento",
        )

    def care_diagnoses(self) -> DataFrame:
        return self["orders"].selectExpr("o_orderpriority AS id_cid").distinct()

    def care_procedures(self) -> DataFrame:
        return self["region"].selectExpr("cast(r_regionkey AS string) AS id_procedimento")

    def birth_dates(self) -> DataFrame:
        return self["customer"].selectExpr(
            "cast(c_custkey AS string) AS id_cns_paciente",
            "make_date(cast(c_custkey % 60 + 1930 AS int), cast(c_custkey % 12 + 1 AS int), "
            "cast(c_custkey % 28 + 1 AS int)) AS data_nascimento",
        )

    def age_bands(self) -> DataFrame:
        """Five-year bands by month of age, up to 120 years."""
        return self.spark.range(0, 1440).selectExpr(
            "id AS idade_meses", "concat(id div 60 * 5, '-', id div 60 * 5 + 4) AS faixa_etaria_ibge"
        )
