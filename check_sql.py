"""The same results as plain SQL over the given tables, for checking.

Written the direct way (nested subqueries, outer joins, unbounded windows), not the way the
library computes them.  A column list gives each output column its comparable type:
``i`` whole number, ``n`` fraction, ``r`` fraction to seven digits, ``d`` moment as text, ``s`` anything already comparable.
"""

from __future__ import annotations

_TYPES = {
    "i": "CAST({0} AS BIGINT)",
    "n": "round(CAST({0} AS DOUBLE), 6)",
    "d": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
    "r": "printf('%.6e', CAST({0} AS DOUBLE))",
    "s": "{0}",
}

_TABLES = {
    "drivers": """SELECT s_suppkey AS driverId, split_part(s_name, '#', 1) AS forename,
        split_part(s_name, '#', 2) AS surname FROM supplier""",
    "constructors": "SELECT p_partkey AS constructorId, p_brand AS name FROM part",
    "races": """SELECT o_orderkey AS raceId, year(o_orderdate) AS year, o_custkey AS circuitId,
        o_orderpriority AS name, CAST(o_orderdate AS DATE) AS date FROM orders""",
    "circuits": """SELECT c_custkey AS circuitId, c_name AS name, n_name AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "status": "SELECT r_regionkey AS statusId, r_name AS status FROM region",
    "results": """SELECT l_orderkey AS raceId, l_suppkey AS driverId, l_partkey AS constructorId,
        l_linenumber % 5 AS statusId, l_extendedprice AS points, l_linenumber AS positionOrder,
        CAST(trunc(l_quantity) AS INTEGER) AS grid, CAST(round(l_discount * 100) AS INTEGER) AS rank FROM lineitem""",
    "qualifying": """SELECT l_orderkey AS raceId, l_suppkey AS driverId,
        CAST(trunc(l_quantity) AS INTEGER) AS position FROM lineitem""",
    "log": """SELECT event_id // 2000 AS raceId, user_id % 50 AS driverId, event_id, ts, event_type, value,
        CAST(round(value * 100) AS BIGINT) AS cents,
        row_number() OVER (PARTITION BY event_id // 2000, user_id % 50 ORDER BY ts, event_id) AS lap FROM events""",
    "stage_races": """SELECT raceId, 'Stage ' || raceId AS name, CAST(min(ts) AS DATE) AS date FROM log GROUP BY raceId""",
    "stage_results": """SELECT raceId, driverId, driverId % 25 AS constructorId, total % 5 AS statusId,
        total % 26 AS points, total % 20 + 1 AS positionOrder, best % 20 + 1 AS grid, laps,
        CAST(total AS VARCHAR) AS time, CAST(best AS VARCHAR) AS fastestLapTime, best / 100.0 AS fastestLapSpeed
        FROM (SELECT raceId, driverId, count(*) AS laps, sum(cents) AS total, max(cents) AS best
              FROM log GROUP BY raceId, driverId)""",
    "stage_constructors": "SELECT n_nationkey AS constructorId, n_name AS name FROM nation",
    "stage_qualifying": """SELECT raceId, driverId, min(cents) % 20 + 1 AS position, CAST(min(cents) AS VARCHAR) AS q1,
        CAST(max(cents) AS VARCHAR) AS q2, CAST(NULL AS VARCHAR) AS q3
        FROM log WHERE event_type = 'signup' GROUP BY raceId, driverId""",
    "lap_times": """SELECT raceId, driverId, lap,
        CASE WHEN event_type <> 'error' THEN cents % 20 + 1 END AS position, event_type AS time,
        cents AS milliseconds FROM log""",
    "pit_stops": """SELECT raceId, driverId, lap, 1 AS stop,
        CASE WHEN cents > 10000 THEN '1:' || (cents % 60) ELSE CAST(cents % 60 AS VARCHAR) END AS duration
        FROM log WHERE event_type = 'purchase'""",
    "movies": """SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey AS Title, l_returnflag AS Major_Genre,
        l_shipdate AS Release_Date, l_extendedprice AS Production_Budget,
        l_extendedprice * (1 + l_tax) AS Worldwide_Gross, l_extendedprice * (1 - l_discount) AS US_Gross,
        l_quantity / 5 AS IMDB_Rating, l_linenumber * 20.0 AS Running_Time_min FROM lineitem""",
    "country_years": """SELECT o_orderkey AS country, o_orderpriority AS continent, year(o_orderdate) AS year,
        o_custkey % 60 + 25.5 AS lifeExp, o_totalprice / 25 AS gdpPercap, o_totalprice * 100 AS pop FROM orders""",
    "creatures": """SELECT p_partkey AS "#", p_name || ' ' || p_partkey AS "Name", p_type AS "Type 1", p_size AS "HP",
        c % 191 AS "Attack", c % 53 AS "Defense", p_size * 3 AS "Sp. Atk", c % 71 AS "Sp. Def",
        p_size + c % 7 AS "Speed", 1 AS "Generation", 'False' AS "Legendary"
        FROM (SELECT *, CAST(round(p_retailprice * 10) AS INTEGER) AS c FROM part)""",
    "idade_vezes": "SELECT CAST(c_custkey AS VARCHAR) AS id_cns_paciente, k FROM customer, range(3) t(k)",
    "municipios": "SELECT CAST(k % 7 AS VARCHAR) AS id_municipio FROM range(14) t(k)",
    "ultimo_ano": "SELECT max(year(o_orderdate)) AS ano FROM orders",
    "internacoes": """SELECT CAST(o_orderkey // 2 AS VARCHAR) AS id_aih, o_orderdate AS dt_entrada_internacao,
        o_custkey % 60 + 11 AS id_motivo_saida_permanencia, o_totalprice AS vl_total_aih,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS ind_obito,
        CAST(year(o_orderdate) AS VARCHAR) AS partition_0 FROM orders""",
    "ponte_cid": "SELECT CAST(l_orderkey // 2 AS VARCHAR) AS id_aih, CAST(l_suppkey AS VARCHAR) AS cid FROM lineitem",
    "ponte_proc": """SELECT CAST(l_orderkey // 2 AS VARCHAR) AS id_aih,
        CAST(l_partkey % 25 AS VARCHAR) AS id_procedimento FROM lineitem""",
    "dim_cid": "SELECT CAST(s_suppkey AS VARCHAR) AS id_cid FROM supplier",
    "dim_proc": "SELECT CAST(n_nationkey AS VARCHAR) AS id_procedimento FROM nation",
    "producao": """SELECT CAST(o_custkey AS VARCHAR) AS id_cns_paciente, o_orderpriority AS id_cid_principal,
        CAST(o_orderkey % 5 AS VARCHAR) AS id_procedimento_principal, o_orderdate AS dt_atendimento FROM orders""",
    "amb_cid": "SELECT DISTINCT o_orderpriority AS id_cid FROM orders",
    "amb_proc": "SELECT CAST(r_regionkey AS VARCHAR) AS id_procedimento FROM region",
    "idade": """SELECT CAST(c_custkey AS VARCHAR) AS id_cns_paciente,
        make_date(1930 + c_custkey % 60, 1 + c_custkey % 12, 1 + c_custkey % 28) AS data_nascimento FROM customer""",
    "faixas": """SELECT range AS idade_meses, (range // 60 * 5) || '-' || (range // 60 * 5 + 4) AS faixa_etaria_ibge
        FROM range(0, 1440)""",
}

_STAR = "results res JOIN races r ON r.raceId = res.raceId JOIN constructors c ON c.constructorId = res.constructorId"

_CARE = """
  SELECT p.id_cns_paciente, p.dt_atendimento FROM producao p
  LEFT JOIN amb_cid d ON p.id_cid_principal = d.id_cid
  LEFT JOIN idade_vezes i ON i.id_cns_paciente = p.id_cns_paciente
  LEFT JOIN municipios m ON m.id_municipio = CAST(CAST(p.id_cns_paciente AS BIGINT) % 7 AS VARCHAR)
  LEFT JOIN amb_proc k ON p.id_procedimento_principal = k.id_procedimento
  WHERE d.id_cid IN ('1-URGENT', '3-MEDIUM') {procedures}"""
_CHOSEN_CARE = "AND k.id_procedimento IN ('0', '3')"
_RECENT_CARE = " AND (SELECT ano FROM ultimo_ano) - year(p.dt_atendimento) <= 3"
_CARE_TABLES = "producao amb_cid amb_proc idade idade_vezes municipios faixas ultimo_ano"

_BANDS = """
  SELECT m.id_cns_paciente, f.faixa_etaria_ibge AS faixa_etaria_diagnostico
  FROM (SELECT DISTINCT i.id_cns_paciente,
               date_sub('month', CAST(i.data_nascimento AS TIMESTAMP), g.data_diagnostico) AS idade_meses
        FROM idade i JOIN (SELECT id_cns_paciente, min(dt_atendimento) AS data_diagnostico
                           FROM ({care}) GROUP BY id_cns_paciente) g ON g.id_cns_paciente = i.id_cns_paciente) m
  JOIN faixas f ON f.idade_meses = m.idade_meses"""

_COHORT = """
  EXISTS (SELECT 1 FROM ponte_cid b JOIN dim_cid d ON b.cid = d.id_cid
          WHERE d.id_cid IN ('3', '17', '42', '58', '77') AND b.id_aih = a.id_aih)
  AND EXISTS (SELECT 1 FROM ponte_proc b JOIN dim_proc d ON b.id_procedimento = d.id_procedimento
              WHERE {procedures} AND b.id_aih = a.id_aih)"""
_CHOSEN = _COHORT.format(procedures="d.id_procedimento IN ('1', '5', '9', '13', '20')")
_ANY = _COHORT.format(procedures="TRUE")
_RECENT = " AND (SELECT ano FROM ultimo_ano) - year(a.dt_entrada_internacao) <= 3"
_LAKE_TABLES = "internacoes ponte_cid ponte_proc dim_cid dim_proc ultimo_ano"
_ADMISSIONS = f"SELECT count(DISTINCT id_aih) AS n_internacoes FROM internacoes a WHERE {_CHOSEN} {_RECENT}"
_COST = f"""SELECT sum(v) / count(DISTINCT id_aih) AS media_custo_internacao
  FROM (SELECT id_aih, sum(vl_total_aih) AS v FROM internacoes a
        WHERE id_motivo_saida_permanencia // 10 IN (1, 4, 5, 6) AND {_CHOSEN} {_RECENT} GROUP BY id_aih)"""
_STAYS = f"""SELECT id_aih, id_motivo_saida_permanencia, ind_obito,
    CASE WHEN ind_obito = 1 THEN '3. Óbito' WHEN id_motivo_saida_permanencia // 10 IN (1, 4, 5, 6) THEN '1. Alta'
         ELSE '2. Permanência' END AS alta_obito,
    date_trunc('month', dt_entrada_internacao) AS data_internacao
  FROM internacoes s WHERE EXISTS (
    SELECT 1 FROM internacoes a WHERE {_CHOSEN} AND (SELECT ano FROM ultimo_ano) - CAST(a.partition_0 AS INTEGER) <= 2
    AND a.id_aih = s.id_aih)"""

_SCORE = """SELECT count(CASE WHEN positionOrder = 1 THEN 1 END) AS total_wins,
    count(CASE WHEN positionOrder <= 3 THEN 1 END) AS total_podiums, count(*) AS total_races,
    round(sum(points), 0) AS total_points, count(CASE WHEN grid = 1 THEN 1 END) AS pole_positions,
    count(CASE WHEN rank = 1 THEN 1 END) AS fastest_laps
  FROM results res JOIN races r ON res.raceId = r.raceId"""
_SCORE_COLUMNS = (
    "total_wins:i total_podiums:i total_races:i total_points:n pole_positions:i fastest_laps:i"
)

_PROGRESS = f"""SELECT res.driverId, r.year, points, res.raceId, c.name AS constructor_name, r.name AS race_name, r.date,
    res.constructorId, positionOrder, sum(points) OVER w AS cumulative_points, row_number() OVER w AS index
  FROM {_STAR}
  WINDOW w AS (PARTITION BY res.driverId, r.year ORDER BY r.date, res.raceId, res.constructorId, positionOrder
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_PROGRESS_COLUMNS = (
    "driverId:i year:i points:n raceId:i constructor_name:s race_name:s date:d constructorId:i positionOrder:i "
    "cumulative_points:n index:i"
)

_LAPS = """SELECT *, lag(position) OVER (PARTITION BY raceId, driverId ORDER BY lap) AS prev_position,
    row_number() OVER (PARTITION BY raceId, driverId ORDER BY milliseconds, lap) AS fastest_lap_rank FROM lap_times"""
_LAP_COLUMNS = "raceId:i driverId:i lap:i position:i time:s milliseconds:i prev_position:i fastest_lap_rank:i"

_SCORECARD = f"""
  SELECT res.raceId, res.driverId, r.name AS race_name, r.date AS race_date, c.name AS constructor_name,
    res.grid AS start_position, res.positionOrder AS finish_position, q.q1 AS qualifying_1, q.q2 AS qualifying_2,
    q.q3 AS qualifying_3, q.position AS qualifying_position, res.points AS points_earned, res.laps AS laps_completed,
    res.time AS race_time, res.fastestLapTime AS fastest_lap_time, res.fastestLapSpeed AS fastest_lap_speed,
    s.status AS race_status, coalesce(l.lost, 0) AS positions_lost, coalesce(l.gained, 0) AS positions_gained,
    l.best AS best_lap_time_ms, l.mean AS avg_lap_time_ms, l.worst AS worst_lap_time_ms,
    coalesce(p.stops, 0) AS total_pit_stops, p.mean AS avg_pit_stop_duration, t.starters AS total_drivers_in_race,
    t.incidents AS incidents_count
  FROM stage_races r JOIN stage_results res ON r.raceId = res.raceId
  JOIN stage_constructors c ON res.constructorId = c.constructorId
  JOIN status s ON res.statusId = s.statusId
  LEFT JOIN stage_qualifying q ON r.raceId = q.raceId AND q.driverId = res.driverId
  LEFT JOIN (SELECT raceId, driverId, count(CASE WHEN position < prev_position THEN 1 END) AS lost,
                    count(CASE WHEN position > prev_position THEN 1 END) AS gained, min(milliseconds) AS best,
                    avg(milliseconds) AS mean, max(milliseconds) AS worst
             FROM ({_LAPS}) GROUP BY raceId, driverId) l ON l.raceId = res.raceId AND l.driverId = res.driverId
  LEFT JOIN (SELECT raceId, driverId, count(*) AS stops, avg(try_cast(duration AS FLOAT)) AS mean
             FROM pit_stops GROUP BY raceId, driverId) p ON p.raceId = res.raceId AND p.driverId = res.driverId
  JOIN (SELECT raceId, count(*) AS starters, count(DISTINCT CASE WHEN statusId IN (
               SELECT statusId FROM status WHERE status LIKE '%AFR%' OR status LIKE '%EAST%') THEN driverId END) AS incidents
        FROM stage_results GROUP BY raceId) t ON t.raceId = res.raceId"""
_SCORECARD_COLUMNS = (
    "raceId:i driverId:i race_name:s race_date:d constructor_name:s start_position:i finish_position:i qualifying_1:s "
    "qualifying_2:s qualifying_3:s qualifying_position:i points_earned:i laps_completed:i race_time:s "
    "fastest_lap_time:s fastest_lap_speed:n race_status:s positions_lost:i positions_gained:i best_lap_time_ms:i "
    "avg_lap_time_ms:n worst_lap_time_ms:i total_pit_stops:i avg_pit_stop_duration:n total_drivers_in_race:i "
    "incidents_count:i"
)
_DRILL_TABLES = "log stage_races stage_results stage_constructors status stage_qualifying lap_times pit_stops"
_DRILLDOWN = f"""SELECT k.*, lap_times_array, positions_array, pit_stop_laps_array
  FROM ({_SCORECARD}) k
  LEFT JOIN (SELECT raceId, driverId, string_agg(time, ',' ORDER BY lap) AS lap_times_array,
                    string_agg(coalesce(CAST(position AS VARCHAR), '-'), ',' ORDER BY lap) AS positions_array
             FROM lap_times GROUP BY ALL) x ON x.raceId = k.raceId AND x.driverId = k.driverId
  LEFT JOIN (SELECT raceId, driverId, string_agg(CAST(lap AS VARCHAR), ',' ORDER BY lap) AS pit_stop_laps_array
             FROM pit_stops GROUP BY ALL) y ON y.raceId = k.raceId AND y.driverId = k.driverId"""

_SIX = '"HP", "Attack", "Defense", "Sp. Atk", "Sp. Def", "Speed"'
_CREATURE_COLUMNS = "#:i Name:s Type·1:s HP:i Attack:i Defense:i Sp.·Atk:i Sp.·Def:i Speed:i Generation:i Legendary:s"


def _values(attribute: str, table: str) -> str:
    return f'SELECT "Type 1" AS g, CAST({attribute} AS DOUBLE) AS v FROM {table} WHERE ({attribute}) IS NOT NULL'


def _binned(values: str, bins: int | None = None) -> str:
    """Per group: bounds, count, deviation, number of bins, first edge, width."""
    automatic = """greatest(ceil(log2(n) + 1),
        coalesce(ceil((hi - lo) / nullif(2 * (q3 - q1) * pow(n, -1.0 / 3), 0)), 0))"""
    return f"""SELECT *, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS start,
        CASE WHEN lo = hi THEN 1.0 / {bins or 1} ELSE (hi - lo) / bins END AS width
      FROM (SELECT *, CAST({bins or f'CASE WHEN lo = hi THEN 1 ELSE {automatic} END'} AS BIGINT) AS bins
            FROM (SELECT g, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd,
                         quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM ({values}) GROUP BY g))"""


def _histogram(values: str, bins: int | None = None) -> str:
    return f"""SELECT g AS "group", bins, bin, start + bin * width AS bin_start, start + (bin + 1) * width AS bin_end,
        count(*) AS count
      FROM (SELECT *, CASE WHEN v < start + k * width THEN k - 1
                           WHEN v >= start + (k + 1) * width AND k < bins - 1 THEN k + 1 ELSE k END AS bin
            FROM (SELECT b.*, x.v, least(b.bins - 1, CAST(floor((x.v - b.start) / b.width) AS BIGINT)) AS k
                  FROM ({values}) x JOIN ({_binned(values, bins)}) b ON b.g = x.g))
      GROUP BY g, bins, bin, start, width"""


def _density(values: str) -> str:
    return f"""SELECT b.g AS "group", k AS point, lo + k * (hi - lo) / 199 AS x,
        sum(c * exp(-0.5 * pow((lo + k * ((hi - lo) / 199) - v) / (sd * pow(n, -0.2)), 2)))
          * any_value(width) / (any_value(sd) * pow(any_value(n), -0.2) * sqrt(2 * pi())) AS density
      FROM ({_binned(values)}) b
      JOIN (SELECT g, v, count(*) AS c FROM ({values}) GROUP BY g, v) x ON x.g = b.g, range(0, 200) AS t(k)
      WHERE n > 1 AND sd > 0 GROUP BY b.g, k, lo, hi"""


def _column_types(**tables: str) -> str:
    """Type a CSV reader infers for each column, from the type the column has."""
    kind = """CASE typeof(any_value({0})) WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'int' END"""
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, {place} AS position, '{column}' AS column_name,
            {kind.format(column)} AS data_type FROM {table}"""
        for table, columns in tables.items()
        for place, column in enumerate(columns.split(), start=1)
    )


_HISTOGRAM_COLUMNS = "group:s bins:i bin:i bin_start:n bin_end:n count:i"
_DENSITY_COLUMNS = "group:s point:i x:n density:r"
_PERIOD_NOW = "Release_Date >= TIMESTAMP '1998-03-01' AND Release_Date <= TIMESTAMP '1999-03-01'"
_PERIOD_THEN = "Release_Date >= TIMESTAMP '1997-03-01' AND Release_Date <= TIMESTAMP '1998-03-01'"
_CARDS = [
    ("Average Gross", "Worldwide_Gross"),
    ("Average Budget", "US_Gross"),
    ("Average Runtime", "Running_Time_min"),
    ("Average Rating", "IMDB_Rating"),
]


def _period_cards() -> str:
    parts = [
        f"""SELECT 1 AS place, 'Total Movies' AS card,
          (SELECT CAST(count(*) AS DOUBLE) FROM movies WHERE {_PERIOD_NOW}) AS current,
          (SELECT CAST(count(*) AS DOUBLE) FROM movies WHERE {_PERIOD_THEN}) AS previous"""
    ]
    for place, (label, measure) in enumerate(_CARDS, start=2):
        parts.append(
            f"""SELECT {place}, '{label}', (SELECT avg({measure}) FROM movies WHERE {_PERIOD_NOW}),
              (SELECT avg({measure}) FROM movies WHERE {_PERIOD_THEN})"""
        )
    rated = "SELECT *, (current - previous) / nullif(previous, 0) AS rate FROM (" + " UNION ALL ".join(parts) + ")"
    return f"""SELECT place, card, current, previous, CASE WHEN place = 1 THEN coalesce(rate, 0) ELSE rate END AS rate,
        CASE WHEN rate > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM ({rated})"""


def _lookup() -> dict[str, tuple[str, str, str]]:
    """Query name -> (tables it needs, statement, output columns)."""
    return {
        "q01_driver_options": (
            "drivers",
            "SELECT driverId, concat(forename, ' ', surname) AS driver_name FROM drivers",
            "driverId:i driver_name:s",
        ),
        "q02_driver_id_of": (
            "drivers",
            "SELECT min(driverId) AS driverId FROM drivers WHERE forename || ' ' || surname = 'Supplier 000000007'",
            "driverId:i",
        ),
        "q03_constructor_options": (
            "results constructors",
            """SELECT DISTINCT r.driverId, c.constructorId, c.name AS constructor_name
               FROM results r JOIN constructors c ON r.constructorId = c.constructorId""",
            "driverId:i constructorId:i constructor_name:s",
        ),
        "q04_constructor_id_of": (
            "results constructors",
            """SELECT min(c.constructorId) AS constructorId FROM results r
               JOIN constructors c ON r.constructorId = c.constructorId WHERE r.driverId = 7 AND c.name = 'Brand#11'""",
            "constructorId:i",
        ),
        "q05_season_points": (
            "results races constructors",
            f"""SELECT driverId, r.year, c.name AS constructor_name, sum(points) AS total_points FROM {_STAR}
                GROUP BY driverId, r.year, c.name""",
            "driverId:i year:i constructor_name:s total_points:n",
        ),
        "q05_season_points_one_driver": (
            "results races constructors",
            f"""SELECT driverId, r.year, c.name AS constructor_name, sum(points) AS total_points FROM {_STAR}
                WHERE driverId = 7 AND (NULL IS NULL OR res.constructorId = NULL) GROUP BY driverId, r.year, c.name""",
            "driverId:i year:i constructor_name:s total_points:n",
        ),
        "q06_race_points": (
            "results races constructors",
            f"""SELECT driverId, r.year, points, r.raceId, c.name AS constructor_name, r.name AS race_name, r.date
                FROM {_STAR}""",
            "driverId:i year:i points:n raceId:i constructor_name:s race_name:s date:d",
        ),
        "q07_career_scorecard": (
            "results races",
            _SCORE.replace("SELECT", "SELECT driverId,", 1) + " GROUP BY driverId",
            "driverId:i " + _SCORE_COLUMNS,
        ),
        "q07_scorecard_absent_driver": (
            "results races",
            _SCORE.replace("SELECT", "SELECT -1 AS driverId,", 1) + " WHERE driverId = -1",
            "driverId:i " + _SCORE_COLUMNS,
        ),
        "q08_selected_season": (
            "results races constructors",
            f"SELECT min(r.year) AS year FROM {_STAR} WHERE driverId = 7",
            "year:i",
        ),
        "q09_season_progression": ("results races constructors", _PROGRESS, _PROGRESS_COLUMNS),
        "q10_podium_split": (
            "results races",
            " UNION ALL ".join(
                f"""SELECT driverId, year, {place} AS place, '{label}' AS "Position",
                    count(CASE WHEN positionOrder = {place} THEN 1 END) AS "Count"
                    FROM results res JOIN races r ON res.raceId = r.raceId GROUP BY driverId, year"""
                for place, label in enumerate(("🥇 Wins", "🥈 Seconds", "🥉 Thirds"), start=1)
            ),
            "driverId:i year:i place:i Position:s Count:i",
        ),
        "q11_non_finish_reasons": (
            "results races status",
            """SELECT driverId, year, s.status, count(*) AS count FROM results res JOIN races r ON res.raceId = r.raceId
               JOIN status s ON res.statusId = s.statusId WHERE s.status NOT IN ('ASIA', 'EUROPE')
               GROUP BY driverId, year, s.status""",
            "driverId:i year:i status:s count:i",
        ),
        "q11_reasons_one_season": (
            "results races status",
            """SELECT driverId, year, s.status, count(*) AS count FROM results res JOIN races r ON res.raceId = r.raceId
               JOIN status s ON res.statusId = s.statusId WHERE driverId = 7 AND year = 1998
               AND s.status NOT IN ('ASIA', 'EUROPE') GROUP BY driverId, year, s.status""",
            "driverId:i year:i status:s count:i",
        ),
        "q12_qualifying_vs_race": (
            "results races qualifying",
            """SELECT res.driverId, r.raceId, r.year, r.name AS race_name, q.position AS qualifying_position,
                 res.positionOrder AS race_position
               FROM races r JOIN qualifying q ON r.raceId = q.raceId
               JOIN results res ON r.raceId = res.raceId AND q.driverId = res.driverId""",
            "driverId:i raceId:i year:i race_name:s qualifying_position:i race_position:i",
        ),
        "q13_venues": (
            "results races circuits",
            """SELECT DISTINCT driverId, c.circuitId, c.name AS circuit_name, c.country FROM circuits c
               JOIN races r ON c.circuitId = r.circuitId JOIN results res ON r.raceId = res.raceId""",
            "driverId:i circuitId:i circuit_name:s country:s",
        ),
        "q13_venues_between_years": (
            "results races circuits",
            """SELECT DISTINCT driverId, c.circuitId, c.name AS circuit_name, c.country FROM circuits c
               JOIN races r ON c.circuitId = r.circuitId JOIN results res ON r.raceId = res.raceId
               WHERE r.year BETWEEN 1996 AND 1997""",
            "driverId:i circuitId:i circuit_name:s country:s",
        ),
        "q14_race_drilldown": (
            _DRILL_TABLES,
            _DRILLDOWN,
            _SCORECARD_COLUMNS + " lap_times_array:s positions_array:s pit_stop_laps_array:s",
        ),
        "q14_race_scorecard": (_DRILL_TABLES, _SCORECARD, _SCORECARD_COLUMNS),
        "q14_lap_analysis": ("log lap_times", _LAPS, _LAP_COLUMNS),
        "q14_pit_summary": (
            "log pit_stops",
            """SELECT raceId, driverId, count(*) AS total_pit_stops, avg(try_cast(duration AS FLOAT)) AS avg_pit_stop_duration,
                 count(CASE WHEN try_cast(duration AS FLOAT) IS NULL THEN 1 END) AS unreadable_durations,
                 string_agg(CAST(lap AS VARCHAR), ',' ORDER BY lap) AS pit_stop_laps_array
               FROM pit_stops GROUP BY raceId, driverId""",
            "raceId:i driverId:i total_pit_stops:i avg_pit_stop_duration:n unreadable_durations:i pit_stop_laps_array:s",
        ),
        "q15_year_snapshot": (
            "country_years",
            """SELECT *, sqrt(pop * 2.666051223553066e-05) AS size, sqrt(pop * 2.666051223553066e-05) * 6 AS size_hvplot
               FROM country_years WHERE year = 1998 AND gdpPercap < 10000""",
            "country:i continent:s year:i lifeExp:n gdpPercap:n pop:n size:n size_hvplot:n",
        ),
        "q15_all_years": (
            "country_years",
            """SELECT *, sqrt(pop * 2.666051223553066e-05) AS size, sqrt(pop * 2.666051223553066e-05) * 6 AS size_hvplot
               FROM country_years WHERE gdpPercap < 10000""",
            "country:i continent:s year:i lifeExp:n gdpPercap:n pop:n size:n size_hvplot:n",
        ),
        "q16_axis_bounds": (
            "country_years",
            """SELECT (SELECT min(gdpPercap) FROM country_years) - 100 AS x_min,
                 (SELECT max(gdpPercap) FROM country_years WHERE gdpPercap < 10000) + 1000 AS x_max""",
            "x_min:n x_max:n",
        ),
        "q17_years": ("country_years", "SELECT DISTINCT year FROM country_years", "year:i"),
        "q17_default_year": ("country_years", "SELECT max(year) AS year FROM country_years", "year:i"),
        "q17_next_years": (
            "country_years",
            """SELECT y.year, coalesce((SELECT min(z.year) FROM country_years z WHERE z.year > y.year),
                 (SELECT min(year) FROM country_years)) AS next_year FROM (SELECT DISTINCT year FROM country_years) y""",
            "year:i next_year:i",
        ),
        "q18_period_rows": (
            "movies",
            f"""SELECT Title, Release_Date, 'current' AS period FROM movies WHERE {_PERIOD_NOW}
                UNION ALL SELECT Title, Release_Date, 'previous' FROM movies WHERE {_PERIOD_THEN}""",
            "Title:s Release_Date:d period:s",
        ),
        "q19_period_cards": (
            "movies",
            _period_cards(),
            "place:i card:s current:n previous:n rate:n direction:s",
        ),
        "q20_brushed_cards": (
            "movies",
            """SELECT count(*) AS total_movies, avg(Worldwide_Gross) AS average_gross, avg(US_Gross) AS average_budget,
                 avg(Running_Time_min) AS average_runtime, avg(IMDB_Rating) AS average_rating
               FROM movies WHERE Production_Budget BETWEEN 20000 AND 60000 AND IMDB_Rating BETWEEN 3 AND 8""",
            "total_movies:i average_gross:n average_budget:n average_runtime:n average_rating:n",
        ),
        "q21_genre_counts": (
            "movies",
            """SELECT Major_Genre, Release_Date, count(*) AS count, sum(count(*)) OVER (PARTITION BY Major_Genre) AS genre_total
               FROM movies GROUP BY Major_Genre, Release_Date""",
            "Major_Genre:s Release_Date:d count:i genre_total:i",
        ),
        "q22_scatter_rows": (
            "movies",
            f"SELECT * FROM movies WHERE {_PERIOD_NOW}",
            "Title:s Production_Budget:n IMDB_Rating:n Worldwide_Gross:n Major_Genre:s",
        ),
        "q23_decade_rows": (
            "movies",
            " UNION ALL ".join(
                f"""SELECT Title, Release_Date, {d} AS decade, DATE '{d}-01-01' AS decade_start,
                    DATE '{d + 10}-01-01' AS decade_end
                    FROM movies WHERE Release_Date >= DATE '{d}-01-01' AND Release_Date <= DATE '{d + 10}-01-01'"""
                for d in (1980, 1990, 2000)
            ),
            "Title:s Release_Date:d decade:i decade_start:d decade_end:d",
        ),
        "q24_type_counts": (
            "creatures",
            'SELECT "Type 1" AS type, count("#") AS count FROM creatures GROUP BY "Type 1"',
            "type:s count:i",
        ),
        "q25_of_types": (
            "creatures",
            """SELECT * FROM creatures WHERE "Type 1" = 'PROMO' UNION ALL SELECT * FROM creatures WHERE "Type 1" = 'SMALL'""",
            _CREATURE_COLUMNS,
        ),
        "q25_of_types_with_all": (
            "creatures",
            """SELECT * FROM creatures WHERE "Type 1" = 'PROMO' UNION ALL SELECT * FROM creatures""",
            "#:i Name:s Type·1:s",
        ),
        "q26_attribute_histogram": ("creatures", _histogram(_values('"HP"', "creatures")), _HISTOGRAM_COLUMNS),
        "q26_histogram_of_ratio": (
            "creatures",
            _histogram(_values('CAST("Attack" AS DOUBLE) / nullif("Defense", 0)', "creatures")),
            _HISTOGRAM_COLUMNS,
        ),
        "q26_histogram_fixed_bins": ("creatures", _histogram(_values('"Attack"', "creatures"), 10), _HISTOGRAM_COLUMNS),
        "q26_attribute_density": ("creatures", _density(_values('"Speed"', "creatures")), _DENSITY_COLUMNS),
        "q26_histogram_of_lines": (
            "",
            _histogram("SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem"),
            _HISTOGRAM_COLUMNS,
        ),
        "q26_density_of_lines": (
            "",
            _density("SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem"),
            _DENSITY_COLUMNS,
        ),
        "q27_radar": (
            "creatures",
            " UNION ALL ".join(
                f"""SELECT "#", "Name", {position} AS position, '{spoke}' AS spoke, "{spoke}" AS value,
                    2 * pi() * {position} / 7 AS angle FROM creatures"""
                for position, spoke in enumerate(("HP", "Attack", "Defense", "Sp. Atk", "Sp. Def", "Speed", "HP"))
            ),
            "#:i Name:s position:i spoke:s value:n angle:n",
        ),
        "q28_admissions_count": (_LAKE_TABLES, _ADMISSIONS, "n_internacoes:i"),
        "q28_any_procedure": (
            _LAKE_TABLES,
            f"SELECT count(DISTINCT id_aih) AS n_internacoes FROM internacoes a WHERE {_ANY} {_RECENT}",
            "n_internacoes:i",
        ),
        "q28_no_diagnosis": (
            "internacoes",
            "SELECT count(DISTINCT id_aih) AS n_internacoes FROM internacoes WHERE FALSE",
            "n_internacoes:i",
        ),
        "q29_mean_cost": (_LAKE_TABLES, _COST, "media_custo_internacao:n"),
        "q30_admissions_by_year": (
            _LAKE_TABLES,
            f"""SELECT year(data_internacao) AS ano_internacao, count(DISTINCT id_aih) AS qtde_internacoes
                FROM ({_STAYS}) GROUP BY year(data_internacao)""",
            "ano_internacao:i qtde_internacoes:i",
        ),
        "q30_partitioned_admissions": (
            _LAKE_TABLES,
            f"""SELECT year(data_internacao) AS ano_internacao, count(DISTINCT id_aih) AS qtde_internacoes
                FROM ({_STAYS}) GROUP BY year(data_internacao)""",
            "ano_internacao:i qtde_internacoes:i",
        ),
        "q30_cohort_stays": (
            _LAKE_TABLES,
            _STAYS,
            "id_aih:s id_motivo_saida_permanencia:i ind_obito:i alta_obito:s data_internacao:d",
        ),
        "q31_cohort_size": (
            _CARE_TABLES,
            f"""SELECT count(DISTINCT s.id_cns_paciente) AS qt_pacientes
                FROM ({_CARE.format(procedures=_CHOSEN_CARE)} {_RECENT_CARE}) p
                LEFT JOIN ({_BANDS.format(care=_CARE.format(procedures=_CHOSEN_CARE))}) s
                  ON s.id_cns_paciente = p.id_cns_paciente""",
            "qt_pacientes:i",
        ),
        "q31_cohort_size_any_procedure": (
            _CARE_TABLES,
            f"""SELECT count(DISTINCT s.id_cns_paciente) AS qt_pacientes FROM ({_CARE.format(procedures='')} {_RECENT_CARE}) p
                LEFT JOIN ({_BANDS.format(care=_CARE.format(procedures=''))}) s ON s.id_cns_paciente = p.id_cns_paciente""",
            "qt_pacientes:i",
        ),
        "q31_age_bands": (
            _CARE_TABLES,
            _BANDS.format(care=_CARE.format(procedures=_CHOSEN_CARE)),
            "id_cns_paciente:s faixa_etaria_diagnostico:s",
        ),
        "q32_patients_by_year": (
            _CARE_TABLES,
            f"""SELECT year(p.dt_atendimento) AS ano_atendimento, count(DISTINCT p.id_cns_paciente) AS qt_pacientes
                FROM ({_CARE.format(procedures=_CHOSEN_CARE)} {_RECENT_CARE}) p
                LEFT JOIN ({_BANDS.format(care=_CARE.format(procedures=_CHOSEN_CARE))}) s
                  ON s.id_cns_paciente = p.id_cns_paciente GROUP BY 1""",
            "ano_atendimento:i qt_pacientes:i",
        ),
        "q33_stat_cards": (
            "results races " + _LAKE_TABLES,
            " UNION ALL ".join(
                f"SELECT {place} AS place, '{name.replace('_', ' ').title()}' AS label, CAST({name} AS DOUBLE) AS value FROM ({source})"
                for source, names in (
                    (_SCORE + " WHERE driverId = 7", [c.split(":")[0] for c in _SCORE_COLUMNS.split()]),
                    (_ADMISSIONS, ["n_internacoes"]),
                    (_COST, ["media_custo_internacao"]),
                )
                for place, name in enumerate(names, start=1)
            ),
            "place:i label:s value:n",
        ),
        "q34_parameter_rows": (
            "",
            "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
            "c_custkey:i c_name:s c_nationkey:i c_acctbal:n c_mktsegment:s",
        ),
        "q34_single_parameter": (
            "",
            "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING')",
            "c_custkey:i c_name:s c_nationkey:i c_acctbal:n c_mktsegment:s",
        ),
        "q34_missing_parameter": (
            "",
            "SELECT * FROM customer WHERE c_mktsegment IN ('')",
            "c_custkey:i c_name:s c_nationkey:i c_acctbal:n c_mktsegment:s",
        ),
        "s01_csv_folder": (
            "",
            """SELECT n_name, count(*) AS suppliers, sum(s_acctbal) AS balance
               FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
            "n_name:s suppliers:i balance:n",
        ),
        "s02_schema_profile": (
            "",
            _column_types(
                customer="c_custkey c_name c_nationkey c_acctbal c_mktsegment",
                supplier="s_suppkey s_name s_nationkey s_acctbal",
                nation="n_nationkey n_name n_regionkey",
            ),
            "table_name:s position:i column_name:s data_type:s",
        ),
        "s06_sql_over_tables": (
            "",
            """SELECT n_name, count(*) AS customers, sum(c_acctbal) AS balance
               FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name""",
            "n_name:s customers:i balance:n",
        ),
        "s08_inline_records": (
            "",
            """SELECT left(c_mktsegment, 1) AS label, count(*) AS n, max(c_acctbal) AS top FROM customer
               WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') GROUP BY 1""",
            "label:s n:i top:n",
        ),
        "s09_frame_in_sql": (
            "",
            "SELECT c_name AS name, c_mktsegment AS cid FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
            "name:s cid:s",
        ),
        "s04_encoded_csv": (
            "",
            "SELECT p_partkey, p_name || ' né à Ñuñoa, Größe ' || p_size AS label FROM part",
            "p_partkey:i label:s",
        ),
        "s07_json_records": (
            "",
            "SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer",
            "c_custkey:i c_name:s c_acctbal:n",
        ),
        "s10_parquet_sink": (
            "",
            "SELECT o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY o_orderpriority",
            "o_orderpriority:s total:n",
        ),
        "s11_option_snapshot": (
            "",
            "SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS p_partkey FROM part",
            "p_partkey:s",
        ),
        "s12_random_rows": (
            "",
            "SELECT * FROM orders ORDER BY md5('1|' || o_orderkey), o_orderkey LIMIT 5",
            "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:n o_orderdate:d o_orderpriority:s",
        ),
        "s13_page": (
            "",
            "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 20",
            "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:n o_orderdate:d o_orderpriority:s",
        ),
        "s13_page_after": (
            "",
            """SELECT * FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-03-01', 500)
               ORDER BY o_orderdate, o_orderkey LIMIT 10""",
            "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:n o_orderdate:d o_orderpriority:s",
        ),
        "p06_parsed_dates": (
            "",
            "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS parsed FROM orders",
            "o_orderkey:i parsed:d",
        ),
        "p07_option_list": (
            "",
            "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders",
            "o_custkey:s",
        ),
        "f09_excluding": (
            "",
            "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '2-HIGH')",
            "o_orderkey:i",
        ),
        "f18_chosen_keys": (
            "",
            """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
               WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""",
            "o_orderkey:i o_custkey:i o_totalprice:n",
        ),
        "f19_commented_predicates": (
            "",
            """SELECT o_orderkey, year(o_orderdate) AS year FROM orders
               WHERE substring(CAST(o_custkey AS VARCHAR), 1, 1) IN ('1', '4', '5', '6')
                 AND year(o_orderdate) BETWEEN 1996 AND 1998""",
            "o_orderkey:i year:i",
        ),
        "c_date_functions": (
            "",
            """SELECT o_orderkey, year(o_orderdate) AS year, date_trunc('month', o_orderdate) AS month,
                 date_sub('month', CAST(make_date(1960, o_custkey % 12 + 1, o_custkey % 28 + 1) AS TIMESTAMP), o_orderdate) AS months,
                 o_orderdate - INTERVAL 45 DAY AS back, make_date(year(o_orderdate) // 10 * 10, 1, 1) AS decade_from,
                 make_date(year(o_orderdate) // 10 * 10 + 10, 1, 1) AS decade_to,
                 strftime(o_orderdate, '%B %d, %Y') AS spelled FROM orders""",
            "o_orderkey:i year:i month:d months:i back:d decade_from:d decade_to:d spelled:s",
        ),
        "c_number_functions": (
            "",
            """SELECT o_orderkey, sqrt(o_totalprice * 2.666051223553066e-05) AS size, (o_custkey % 60 + 11) // 10 AS digit,
                 CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS FLOAT) END AS number,
                 (o_totalprice - ln(1 + o_custkey)) / nullif(ln(1 + o_custkey), 0) AS rate,
                 CASE WHEN (o_totalprice - o_custkey * 300) / nullif(o_custkey * 300, 0) > 0 THEN 'increase'
                      ELSE 'decrease' END AS direction FROM orders""",
            "o_orderkey:i size:n digit:i number:n rate:n direction:s",
        ),
        "c_text_functions": (
            "",
            """SELECT p_partkey, concat(p_brand, ' ', p_type) AS joined,
                 upper(left(split_part(p_name, ' ', 1), 1)) || substring(split_part(p_name, ' ', 1), 2) || ' '
                   || upper(left(split_part(p_name, ' ', 2), 1)) || substring(split_part(p_name, ' ', 2), 2) AS label,
                 CAST(p_name LIKE '%ring%' OR p_name LIKE '%bolt%' AS INTEGER) AS has_part, left(p_type, 1) AS initial
               FROM part""",
            "p_partkey:i joined:s label:s has_part:i initial:s",
        ),
    }


def statements() -> dict[str, str]:
    built = {}
    for name, (tables, statement, columns) in _lookup().items():
        named = ", ".join(f"{table} AS ({_TABLES[table]})" for table in tables.split())
        outputs = []
        for entry in columns.split():
            column, kind = entry.replace("·", " ").rsplit(":", 1)
            outputs.append(_TYPES[kind].format(f'"{column}"') + f' AS "{column}"')
        built[name] = (f"WITH {named} " if named else "") + f"SELECT {', '.join(outputs)} FROM ({statement})"
    return built
