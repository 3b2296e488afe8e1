"""Ambulatory cohort: patients with chosen diagnoses and procedures.

The dimensions that only multiply rows (sex, race, the two postcode tables) are not joined: every
result is a count of distinct patients.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.dates import completed_months
from tablewright.operators.filters import as_list, recent_years
from tablewright.operators.joins import band_lookup, with_codes
from tablewright.plans.hospital import watermark_year

FRONT = "ambulatorial"
PATIENT = "id_cns_paciente"


def recent_care(watermarks: DataFrame, years: int) -> Column:
    return recent_years(F.col("dt_atendimento"), watermark_year(watermarks, "frente", FRONT), years)


def care_of_interest(
    production: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    cids: Iterable[str],
    chosen: Iterable[str] = (),
) -> DataFrame:
    """Care rows with a chosen diagnosis and, if any is chosen, a chosen procedure.

    Without a chosen procedure the rows need none at all.
    """
    diagnosed, treated = as_list(cids), as_list(chosen)
    if not diagnosed:
        return production.filter(F.lit(False))
    rows = with_codes(production, diagnoses, "id_cid_principal", "id_cid", diagnosed)
    if treated:
        rows = with_codes(rows, procedures, "id_procedimento_principal", "id_procedimento", treated)
    return rows


def diagnosis_dates(care: DataFrame) -> DataFrame:
    """First and last care per patient, in one pass."""
    return care.groupBy(PATIENT).agg(
        F.min("dt_atendimento").alias("data_diagnostico"), F.max("dt_atendimento").alias("dt_atendimento")
    )


def age_bands(first_care: DataFrame, birth_dates: DataFrame, bands: DataFrame) -> DataFrame:
    """Age band at diagnosis: completed months since birth, looked up in the band table."""
    months = completed_months(F.col("data_nascimento"), F.col("data_diagnostico"))
    aged = first_care.join(birth_dates.select(PATIENT, "data_nascimento"), PATIENT).select(
        PATIENT, months.alias("idade_meses")
    )
    return band_lookup(aged.distinct(), bands, "idade_meses").select(
        PATIENT, F.col("faixa_etaria_ibge").alias("faixa_etaria_diagnostico")
    )


def cohort_size(
    watermarks: DataFrame,
    production: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    birth_dates: DataFrame,
    bands: DataFrame,
    cids: Iterable[str],
    chosen: Iterable[str] = (),
    years: int = 1,
) -> DataFrame:
    """Patients with recent care whose age band at first diagnosis is known.

    The year limit has no upper end, so "some care in the last years" is "last care in the last
    years", and one pass over the care rows gives both dates a patient needs.
    """
    patients = diagnosis_dates(care_of_interest(production, diagnoses, procedures, cids, chosen))
    recent = patients.filter(recent_care(watermarks, years))
    return age_bands(recent, birth_dates, bands).agg(F.count_distinct(PATIENT).alias("qt_pacientes"))


def patients_by_year(
    watermarks: DataFrame,
    production: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    cids: Iterable[str],
    chosen: Iterable[str] = (),
    years: int = 1,
) -> DataFrame:
    """Patients per year of care, whether or not their age band is known."""
    care = care_of_interest(
        production.filter(recent_care(watermarks, years)), diagnoses, procedures, cids, chosen
    )
    return (
        care.groupBy(F.year("dt_atendimento").alias("ano_atendimento"))
        .agg(F.count_distinct(PATIENT).alias("qt_pacientes"))
        .orderBy("ano_atendimento")
    )
