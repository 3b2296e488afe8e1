"""Hospital cohort: admissions with chosen diagnoses and procedures in the last years.

Each fact is reduced to one row per admission before it meets another, so every join is between
sides that are unique on the admission id and share its partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.dates import month_start
from tablewright.functions.numbers import leading_digit, ratio
from tablewright.operators.filters import as_list, recent_partitions, recent_years
from tablewright.operators.joins import fits_broadcast, id_filter, join_splittable, keep_existing, keep_known, with_codes
from tablewright.sources.intermediates import stored_and_counted

# Tens digit of discharge codes that end a stay, and the category labels.
DISCHARGE_CODES = (1, 4, 5, 6)
DEATH, DISCHARGE, STAY = "3. Óbito", "1. Alta", "2. Permanência"
SOURCE = "sihsus"


def watermark_year(watermarks: DataFrame, column: str = "base_origem", value: str = SOURCE) -> DataFrame:
    """Last published year, one row; the largest if the table holds several."""
    return watermarks.filter(F.col(column) == value).agg(F.max("dt_max_ano").alias("year"))


@dataclass(frozen=True)
class Cohort:
    """Who has a chosen diagnosis and a chosen procedure.

    ``diagnosed`` has each admission id once and ``treated`` many times; without a diagnosis chosen the cohort is
    empty.  ``might_hold`` tests an id against a Bloom filter of the rarer of the two.
    """

    diagnosed: DataFrame | None
    treated: DataFrame | None
    might_hold: Callable[[Column], Column] | None

    def likely(self, rows: DataFrame) -> DataFrame:
        """Rows that may belong to the cohort, cut where they are read."""
        if self.diagnosed is None:
            return rows.filter(F.lit(False))
        return rows if self.might_hold is None else rows.filter(self.might_hold(F.col("id_aih")))

    def members(self, rows: DataFrame) -> DataFrame:
        """Which of the likely rows, unique by admission id, do belong to it."""
        if self.diagnosed is None:
            return rows.filter(F.lit(False))
        marked = keep_known(rows, self.diagnosed, "id_aih")
        return keep_existing(marked, self.likely(self.treated), "id_aih")


@dataclass(frozen=True)
class Lake:
    """The hospital tables a cohort is drawn from."""

    watermarks: DataFrame
    admissions: DataFrame
    diagnosis_bridge: DataFrame
    procedure_bridge: DataFrame
    diagnoses: DataFrame
    procedures: DataFrame

    def cohort(self, cids: Iterable[str], procedures: Iterable[str]) -> Cohort:
        """Admissions with one of ``cids``, which are mandatory, and one of ``procedures``, or any known one.

        Where either bridge is small enough for the planner to broadcast it, that join alone cuts the admissions.
        Otherwise building the plan writes the distinct ids of the chosen diagnoses, which counts them, and counts the
        rows of the chosen procedures; without a choice of those the diagnoses are taken as the rarer.
        """
        cids, procedures = as_list(cids), as_list(procedures)
        if not cids:
            return Cohort(None, None, None)
        marked = with_codes(self.diagnosis_bridge, self.diagnoses, "cid", "id_cid", cids)
        marked = marked.select("id_aih").distinct()
        treated = with_codes(self.procedure_bridge, self.procedures, "id_procedimento", "id_procedimento", procedures)
        treated = treated.select("id_aih")
        if fits_broadcast(marked) or fits_broadcast(treated):
            return Cohort(marked, treated, None)
        diagnosed, n = stored_and_counted(marked, "diagnosed")
        rows = treated.count() if procedures else None
        rarer, n = (treated, rows) if rows is not None and rows < n else (diagnosed, n)
        return Cohort(diagnosed, treated, id_filter(rarer, "id_aih", n))

    def recent(self, years: int, column: str = "dt_entrada_internacao") -> Column:
        return recent_years(F.col(column), watermark_year(self.watermarks), years)


def _discharged(rows: DataFrame, codes: Iterable[int] | None) -> DataFrame:
    if codes is None:
        return rows
    return rows.filter(leading_digit(F.col("id_motivo_saida_permanencia")).isin(list(codes)))


def admissions_count(
    lake: Lake,
    cids: Iterable[str],
    procedures: Iterable[str] = (),
    years: int = 1,
    discharge_codes: Iterable[int] | None = None,
) -> DataFrame:
    """Number of admissions in the cohort."""
    rows = _discharged(lake.admissions.filter(lake.recent(years)), discharge_codes)
    cohort = lake.cohort(cids, procedures)
    return cohort.members(cohort.likely(rows).select("id_aih").distinct()).agg(F.count("id_aih").alias("n_internacoes"))


def mean_cost(
    lake: Lake,
    cids: Iterable[str],
    procedures: Iterable[str] = (),
    years: int = 1,
    discharge_codes: Iterable[int] | None = DISCHARGE_CODES,
) -> DataFrame:
    """Mean cost of the cohort's admissions; by default of ended stays only."""
    rows = _discharged(lake.admissions.filter(lake.recent(years)), discharge_codes)
    cohort = lake.cohort(cids, procedures)
    costs = cohort.likely(rows).groupBy("id_aih").agg(F.sum("vl_total_aih").alias("valor_total_aih_real"))
    return cohort.members(costs).agg(
        ratio(F.sum("valor_total_aih_real"), F.count("id_aih")).alias("media_custo_internacao")
    )


def discharge_category() -> Column:
    """Death, discharge or continued stay."""
    ended = leading_digit(F.col("id_motivo_saida_permanencia")).isin(list(DISCHARGE_CODES))
    return (
        F.when(F.col("ind_obito") == 1, F.lit(DEATH)).when(ended, F.lit(DISCHARGE)).otherwise(F.lit(STAY))
    )


def _cohort_ids(lake: Lake, cohort: Cohort, years, discharge_codes) -> DataFrame:
    recent = recent_partitions(F.col("partition_0"), watermark_year(lake.watermarks), years)
    rows = _discharged(lake.admissions.filter(recent), discharge_codes)
    return cohort.members(cohort.likely(rows).select("id_aih").distinct())


def cohort_stays(
    lake: Lake,
    cids: Iterable[str],
    procedures: Iterable[str] = (),
    years: int = 1,
    discharge_codes: Iterable[int] | None = None,
) -> DataFrame:
    """Every stay of the cohort's admissions with its discharge category and month of entry.

    The cohort is limited by the partition year; its admissions are then read again by id alone,
    so one with entries in two years keeps both.
    """
    cohort = lake.cohort(cids, procedures)
    ids = _cohort_ids(lake, cohort, years, discharge_codes)
    stays = lake.admissions.select(
        "id_aih",
        "id_motivo_saida_permanencia",
        "ind_obito",
        discharge_category().alias("alta_obito"),
        month_start(F.col("dt_entrada_internacao")).alias("data_internacao"),
    )
    return join_splittable(cohort.likely(stays), ids, ["id_aih"])


def admissions_by_year(
    lake: Lake,
    cids: Iterable[str],
    procedures: Iterable[str] = (),
    years: int = 1,
    discharge_codes: Iterable[int] | None = None,
) -> DataFrame:
    """Cohort admissions per year of entry; an admission with entries in two years counts in both."""
    cohort = lake.cohort(cids, procedures)
    ids = _cohort_ids(lake, cohort, years, discharge_codes)
    entered = cohort.likely(lake.admissions).select("id_aih", F.year("dt_entrada_internacao").alias("ano_internacao")).distinct()
    return (
        entered.join(ids, "id_aih", "left_semi")
        .groupBy("ano_internacao")
        .agg(F.count("id_aih").alias("qtde_internacoes"))
    )
