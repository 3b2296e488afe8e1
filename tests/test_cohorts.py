"""Hospital and ambulatory cohorts."""

from __future__ import annotations

from datetime import date

import pytest
from tablewright.plans import ambulatory, hospital
from tablewright.schemas import AMBULATORY, HOSPITAL


@pytest.fixture(scope="module")
def lake(spark):
    def make(name, rows):
        return spark.createDataFrame(rows, HOSPITAL[name])

    def stay(aih, day, code, cost, dead=0):
        return (aih, day, code, cost, dead, str(day.year))

    return hospital.Lake(
        watermarks=make("max_date_datasus", [("sihsus", "hospitalar", 2020), ("sihsus", "old", 2019), ("siasus", "ambulatorial", 2022)]),
        admissions=make(
            "sih_fato_rd_internacoes",
            [
                stay("a", date(2020, 5, 3), 12, 100.0),
                stay("a", date(2018, 5, 3), 21, 40.0, 1),
                stay("b", date(2019, 1, 1), 41, 10.0),
                stay("c", date(2018, 12, 31), 11, 1000.0),
                stay("d", date(2021, 2, 1), 61, 30.0),
                stay("e", date(2020, 2, 1), 19, 7.0),
                stay("f", date(2020, 2, 1), 51, 9.0),
                stay("g", date(2020, 2, 1), 9, 11.0),
            ],
        ),
        diagnosis_bridge=make(
            "sih_fato_internacao_cid",
            [("a", "M32"), ("a", "G121"), ("b", "M32"), ("c", "M32"), ("d", "M32"), ("e", "X"), ("f", "M32"), ("g", "M32"), ("a", "M32")],
        ),
        procedure_bridge=make(
            "sih_fato_internacao_procedimento",
            [("a", "p1"), ("b", "p2"), ("c", "p1"), ("d", "p1"), ("e", "p1"), ("g", "p2"), ("f", "gone")],
        ),
        diagnoses=make("sig_dim_cid", [("M32",), ("G121",)]),
        procedures=make("sig_dim_procedimento", [("p1",), ("p2",)]),
    )


def test_count_uses_calendar_years_and_any_known_procedure(lake):
    assert hospital.admissions_count(lake, ["M32", "G121"], years=1).first()[0] == 4  # a b d g
    assert hospital.admissions_count(lake, ["M32"], ["p1"], years=1).first()[0] == 2  # a d
    assert hospital.admissions_count(lake, ["M32"], ["p1"], years=2).first()[0] == 3
    assert hospital.admissions_count(lake, "M32", "p2").first()[0] == 2
    assert hospital.admissions_count(lake, [], years=9).first()[0] == 0
    assert hospital.admissions_count(lake, ["unknown"], years=9).first()[0] == 0


def test_discharge_codes_use_whole_tens(lake):
    assert hospital.admissions_count(lake, ["M32"], years=1, discharge_codes=[1, 4, 5, 6]).first()[0] == 3
    # a: 12, b: 41, d: 61 end a stay; g has code 9.
    assert hospital.mean_cost(lake, ["M32"], years=1).first()[0] == pytest.approx(140 / 3)
    assert hospital.mean_cost(lake, ["M32"], years=2, discharge_codes=None).first()[0] == pytest.approx((140 + 10 + 1000 + 30 + 11) / 5)
    assert hospital.mean_cost(lake, ["unknown"]).first()[0] is None


def test_years_read_the_whole_admission(lake):
    rows = {row["ano_internacao"]: row["qtde_internacoes"] for row in hospital.admissions_by_year(lake, ["M32"], years=1).collect()}
    assert rows == {2018: 1, 2019: 1, 2020: 2, 2021: 1}


def test_stays(lake):
    stays = hospital.cohort_stays(lake, ["M32"], ["p1"], years=1).collect()
    got = sorted((row["id_aih"], row["alta_obito"], row["data_internacao"]) for row in stays)
    assert got == [
        ("a", "1. Alta", date(2020, 5, 1)),
        ("a", "3. Óbito", date(2018, 5, 1)),
        ("d", "1. Alta", date(2021, 2, 1)),
    ]


def test_watermark_takes_the_largest(lake):
    assert hospital.watermark_year(lake.watermarks).first()[0] == 2020
    assert hospital.watermark_year(lake.watermarks, "frente", "ambulatorial").first()[0] == 2022


@pytest.fixture(scope="module")
def clinic(spark):
    def make(name, rows):
        return spark.createDataFrame(rows, {**AMBULATORY, **HOSPITAL}[name])

    care = [
        ("u", "M32", "p1", "c1", "c2", date(2015, 6, 30)),
        ("u", "M32", "p1", "c1", "c2", date(2021, 3, 1)),
        ("u", "M32", "p1", "c1", "c2", date(2022, 3, 1)),
        ("v", "M32", "p2", "c1", "c2", date(2022, 2, 28)),
        ("w", "M32", "zz", "c1", "c2", date(2022, 7, 1)),
        ("x", "G12", "p1", "c1", "c2", date(2022, 7, 1)),
        ("y", "M32", "p1", "c1", "c2", date(2019, 7, 1)),
        ("z", "M32", "p1", "c1", "c2", date(2023, 7, 1)),
    ]
    births = [("u", date(2015, 1, 31)), ("v", date(2021, 12, 31)), ("w", date(1900, 1, 1)), ("y", date(2000, 1, 1)), ("z", date(2023, 6, 2)), ("z", date(2023, 6, 1))]
    return {
        "watermarks": make("max_date_datasus", [("siasus", "ambulatorial", 2022)]),
        "production": make("sia_fato_producao_paciente", care),
        "diagnoses": make("sig_dim_cid", [("M32",), ("G12",)]),
        "procedures": make("sig_dim_procedimento", [("p1",), ("p2",)]),
        "birth_dates": make("sia_dim_idade_paciente", births),
        "bands": make("dim_faixas_etarias_meses", [(m, f"{m // 12} years") for m in range(0, 300)]),
    }


def test_cohort_size_needs_a_band(clinic):
    assert ambulatory.cohort_size(**clinic, cids=["M32"], years=1).first()[0] == 3  # u v z; w is too old for a band
    assert ambulatory.cohort_size(**clinic, cids=["M32"], chosen=["p1"], years=1).first()[0] == 2
    assert ambulatory.cohort_size(**clinic, cids=["M32"], years=3).first()[0] == 4
    assert ambulatory.cohort_size(**clinic, cids=[], years=3).first()[0] == 0


def test_years_count_patients_without_a_band(clinic):
    tables = {name: clinic[name] for name in ("watermarks", "production", "diagnoses", "procedures")}
    rows = [tuple(row) for row in ambulatory.patients_by_year(**tables, cids=["M32"], years=1).collect()]
    assert rows == [(2021, 1), (2022, 3), (2023, 1)]


def test_age_is_in_completed_months(clinic):
    care = ambulatory.care_of_interest(clinic["production"], clinic["diagnoses"], clinic["procedures"], ["M32"])
    first = ambulatory.diagnosis_dates(care)
    bands = clinic["bands"].selectExpr("idade_meses", "cast(idade_meses as string) AS faixa_etaria_ibge")
    got = sorted(tuple(row) for row in ambulatory.age_bands(first, clinic["birth_dates"], bands).collect())
    assert got == [("u", "4"), ("v", "1"), ("y", "234"), ("z", "0"), ("z", "1")]
