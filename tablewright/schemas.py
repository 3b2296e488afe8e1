"""Typed schemas of the tables the analyses read, as DDL text."""

from __future__ import annotations

RACING = {
    "drivers": "driverId INT, forename STRING, surname STRING",
    "constructors": "constructorId INT, name STRING",
    "circuits": "circuitId INT, name STRING, country STRING",
    "races": "raceId INT, year INT, circuitId INT, name STRING, date DATE",
    "status": "statusId INT, status STRING",
    "results": (
        "raceId INT, driverId INT, constructorId INT, statusId INT, points DOUBLE, "
        "positionOrder INT, grid INT, rank INT, laps INT, time STRING, "
        "fastestLapTime STRING, fastestLapSpeed DOUBLE"
    ),
    "qualifying": "raceId INT, driverId INT, position INT, q1 STRING, q2 STRING, q3 STRING",
    "lap_times": "raceId INT, driverId INT, lap INT, position INT, time STRING, milliseconds BIGINT",
    "pit_stops": "raceId INT, driverId INT, lap INT, stop INT, duration STRING",
}

HOSPITAL = {
    "max_date_datasus": "base_origem STRING, frente STRING, dt_max_ano INT",
    "sih_fato_rd_internacoes": (
        "id_aih STRING, dt_entrada_internacao DATE, id_motivo_saida_permanencia INT, "
        "vl_total_aih DOUBLE, ind_obito INT, partition_0 STRING"
    ),
    "sih_fato_internacao_cid": "id_aih STRING, cid STRING",
    "sih_fato_internacao_procedimento": "id_aih STRING, id_procedimento STRING",
    "sig_dim_cid": "id_cid STRING",
    "sig_dim_procedimento": "id_procedimento STRING",
}

AMBULATORY = {
    "sia_fato_producao_paciente": (
        "id_cns_paciente STRING, id_cid_principal STRING, id_procedimento_principal STRING, "
        "id_municipio_paciente STRING, id_municipio_estabelecimento STRING, dt_atendimento DATE"
    ),
    "sia_dim_idade_paciente": "id_cns_paciente STRING, data_nascimento DATE",
    "dim_faixas_etarias_meses": "idade_meses BIGINT, faixa_etaria_ibge STRING",
}

MOVIES = (
    "Title STRING, Major_Genre STRING, Release_Date TIMESTAMP_NTZ, Production_Budget DOUBLE, "
    "Worldwide_Gross DOUBLE, US_Gross DOUBLE, IMDB_Rating DOUBLE, Running_Time_min DOUBLE"
)

COUNTRY_YEARS = "country STRING, continent STRING, year INT, lifeExp DOUBLE, gdpPercap DOUBLE, pop DOUBLE"

CREATURES = (
    "`#` INT, Name STRING, `Type 1` STRING, HP INT, Attack INT, Defense INT, "
    "`Sp. Atk` INT, `Sp. Def` INT, Speed INT, Generation INT, Legendary STRING"
)

PARAMETER_ROWS = "name STRING, age INT, city STRING, cid STRING"
