"""Look-ups and health queries (SURVEY groups D, G), each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver.sql import EVENTS, KPIS, LINES, OBS, avg, rnd
from driver.tables import EVENT_DIGITS, LINE_DIGITS, event_kpis, event_star, network_star, sites, table
from starcell.functions.timeparts import stamp_text
from starcell.operators import health, telemetry
from starcell.plans import measures
from starcell.plans.star import Attribute

CELL = "Supplier#000000007"
PLACES = {"latency_ms": 2, "throughput_mbps": 2, "packet_loss_pct": 3, "call_drop_rate_pct": 3,
          "signal_strength_dbm": 2, "handover_success_pct": 2}


def observations(s, d):
    """Every observation with place and time text."""
    rows = network_star(s, d).rows([*telemetry.PLACE, "timestamp"])
    return rows.withColumn("timestamp", stamp_text("timestamp")).drop("l_suppkey")


def latest_requests(s, d):
    """One request per cell: its latest time."""
    rows = network_star(s, d).rows(["cell_id", "timestamp"])
    return rows.groupBy("cell_id").agg(stamp_text(F.max("timestamp")).alias("timestamp"))


def requested_cells(s, d):
    """Cells asked for by customers' keys; only some of them exist."""
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    return table(s, d, "customer").select(F.concat(F.lit("Supplier#"), key).alias("cell_id"))


def overdriven(s, d):
    """Readings scaled until they leave their physical bounds."""
    scale = {"latency_ms": 10.0, "throughput_mbps": 20.0, "packet_loss_pct": 20.0,
             "call_drop_rate_pct": 20.0, "signal_strength_dbm": 1.5, "handover_success_pct": 1.2,
             "active_connections": 20.0}
    return health.clamp_kpis(observations(s, d).withColumns({k: F.col(k) * v for k, v in scale.items()}))


def scenario_scores(s, d):
    """Mean score and alert share of the whole fact under every scenario and severity."""
    rows = health.scenario_targets(network_star(s, d).rows())
    rows = health.with_health(rows)
    block = [measures.row_count("observation_count"),
             measures.mean("avg_health_score", "health_score", 1),
             measures.count_where("critical_count", F.col("health_band") == "CRITICAL CONGESTION")]
    by = ["scenario", "severity"]
    return measures.finish(measures.first_pass(rows, by, block), by, block)


def health_bands(s, d):
    rows = health.with_health(network_star(s, d).rows(["region"]))
    return rows.groupBy("region", "health_band").agg(F.count(F.lit(1)).alias("observation_count"))


def scenario_deltas(s, d):
    first = telemetry.first_baselines(network_star(s, d))
    return health.compare_scenario(first, "CELL_OVERLOAD", "HIGH").drop("region", "technology", "timestamp")


def latest_against_first(s, d):
    """Adverse changes between each cell's first and latest smallest readings."""
    star = network_star(s, d)
    first = telemetry.first_baselines(star).select(
        "cell_id", *[F.col(k).alias(f"baseline_{k}") for k in KPIS])
    last = star.aggregate([measures.highest("last", F.struct(
        F.col("timestamp"), *[F.col(k) for k in KPIS]))], ["cell_id"]).select("cell_id", "last.*")
    last = telemetry.storage_rounding(last).select(
        "cell_id", *[F.col(k).alias(f"simulated_{k}") for k in KPIS])
    rows = health.compare_kpis(first.join(last, "cell_id"), ["cell_id"])
    return rows.where("is_worse").drop("metric_name")


def event_star_with_region(s, d):
    """The events star with the user's traffic class standing in for a region."""
    return event_star(s, d).with_attribute("region", Attribute(F.lit("all")))


QUERIES = {
    "d1_cell_inventory": lambda s, d: telemetry.list_cells(network_star(s, d)),
    "d1_cell_inventory_filtered": lambda s, d: telemetry.list_cells(
        network_star(s, d), region=" middle east", technology="o"),
    "d1_cell_inventory_match_case": lambda s, d: telemetry.list_cells(
        network_star(s, d), region="ASIA", match_case=True),
    "d1_filter_options": lambda s, d: telemetry.filter_options(network_star(s, d)),
    "d2_cell_detail": lambda s, d: telemetry.cell_detail(network_star(s, d)),
    "d2_cell_detail_one": lambda s, d: telemetry.cell_detail(network_star(s, d), CELL),
    "d3_cell_telemetry": lambda s, d: telemetry.cell_telemetry(
        network_star(s, d), CELL, "1996-03-01 00:00:00", "1999-12-31 00:00:00", 200),
    "d4_cell_summary": lambda s, d: telemetry.cell_summary(network_star(s, d), LINE_DIGITS),
    "d4_cell_summary_long": lambda s, d: telemetry.cell_summary_long(event_star_with_region(s, d), EVENT_DIGITS),
    "d5_missing_cells": lambda s, d: telemetry.missing_keys(requested_cells(s, d), sites(s, d), "cell_id"),
    "d5_known_cells": lambda s, d: telemetry.known_keys(requested_cells(s, d), sites(s, d), "cell_id"),
    "d6_first_baselines": lambda s, d: telemetry.first_baselines(network_star(s, d)),
    "d7_baselines_at": lambda s, d: telemetry.baselines_at(network_star(s, d), latest_requests(s, d)),
    "g1_health_score": lambda s, d: health.with_health(observations(s, d)).drop(*KPIS),
    "g2_alerts": lambda s, d: health.alert_rows(observations(s, d), [*telemetry.PLACE, "timestamp"]),
    "g2_alerts_own_thresholds": lambda s, d: health.alert_rows(
        event_kpis(s, d), ["event_id"], {"latency_ms": 40, "packet_loss_pct": 12.5,
                                         "call_drop_rate_pct": 1, "handover_success_pct": 85}),
    "g3_clamped_kpis": overdriven,
    "g4_scenario_targets": lambda s, d: health.scenario_targets(
        telemetry.first_baselines(network_star(s, d))),
    "g4_scenario_scores": scenario_scores,
    "g5_scenario_matrix": lambda s, d: health.scenario_matrix(
        telemetry.first_baselines(network_star(s, d)), "MEDIUM"),
    "g6_scenario_deltas": scenario_deltas,
    "g7_alert_onsets": lambda s, d: health.alert_onsets(event_kpis(s, d), tie=["event_id"]).withColumn(
        "timestamp", stamp_text("timestamp")).drop("message"),
    "g8_storage_rounding": lambda s, d: telemetry.storage_rounding(event_kpis(s, d)).withColumn(
        "timestamp", stamp_text("timestamp")),
    "g9_health_bands": health_bands,
    "g10_adverse_changes": latest_against_first,
}


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
TS = STAMP.format("ts") + " AS timestamp"


def _stored(kpis=KPIS, prefix: str = "", out: str = "") -> str:
    cols = [f"{rnd(prefix + k, PLACES[k])} AS {out}{k}" for k in kpis if k in PLACES]
    cols.append(f"CAST(trunc({prefix}active_connections) AS INTEGER) AS {out}active_connections")
    return ", ".join(cols)


FIRST = f"""{OBS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY ts, region, technology,
  {", ".join(KPIS)}) AS place FROM obs),
firsts AS (SELECT cell_id, region, technology, {TS}, {_stored()} FROM ranked WHERE place = 1)"""


def _limit(x: str, low: float, high: float) -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {x}))"


def _score(p: str = "") -> str:
    parts = [_limit(f"{p}call_drop_rate_pct * 10.0::DOUBLE", 0, 30),
             _limit(f"{p}packet_loss_pct * 4.0::DOUBLE", 0, 20),
             _limit(f"({p}latency_ms - 20.0::DOUBLE) * 0.25::DOUBLE", 0, 20),
             _limit(f"(-70.0::DOUBLE - {p}signal_strength_dbm) * 0.5::DOUBLE", 0, 15),
             _limit(f"(96.0::DOUBLE - {p}handover_success_pct) * 1.5::DOUBLE", 0, 15)]
    return rnd(_limit(f"100.0::DOUBLE - ({' + '.join(parts)})", 0, 100), 1)


def _band(score: str) -> str:
    return (f"CASE WHEN {score} >= 80 THEN 'OPTIMAL HEALTH' WHEN {score} >= 60 "
            "THEN 'DEGRADED PERFORMANCE' ELSE 'CRITICAL CONGESTION' END")


def _alerts(source: str, keys: str, drop=2.0, latency=80.0, loss=3.0, handover=90.0) -> str:
    """Union of the four alert kinds."""
    kinds = [
        ("HIGH_CALL_DROP", "call_drop_rate_pct", f"> {drop}", f">= {drop * 2.5}", drop, 3, 2,
         "Simulated call drop rate (", f"%) exceeds analytical threshold ({drop:.1f}%)."),
        ("HIGH_LATENCY", "latency_ms", f"> {latency}", f">= {latency * 2}", latency, 2, 1,
         "Simulated round-trip latency (", f" ms) exceeds operational ceiling ({latency:.0f} ms)."),
        ("HIGH_PACKET_LOSS", "packet_loss_pct", f"> {loss}", f">= {loss * 2}", loss, 3, 2,
         "Simulated IP packet loss (", f"%) exceeds tolerance ({loss:.1f}%)."),
        ("LOW_HANDOVER_SUCCESS", "handover_success_pct", f"< {handover}", f"< {handover - 10}", handover,
         2, 1, "Simulated inter-cell handover success (",
         f"%) dropped below threshold ({handover:.0f}%)."),
    ]
    return " UNION ALL ".join(
        f"""SELECT {keys}, '{kind}' AS alert_type,
  CASE WHEN {kpi} {critical} THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  {rnd(kpi, stored)} AS current_value, {limit}::DOUBLE AS threshold,
  'SIMULATED CONDITION' AS condition_type,
  '{before}' || printf('%.{shown}f', {rnd(kpi, shown)}) || '{after}' AS message
FROM {source} WHERE {kpi} {test}"""
        for kind, kpi, test, critical, limit, stored, shown, before, after in kinds)


# Fixed values, written here once more so that the SQL does not take them from what it checks:
# factor and shift of latency, throughput, packet loss, call drops, signal, handover, connections.
EFFECT_ROWS = """
('NORMAL', 'LOW', 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0),
('NORMAL', 'MEDIUM', 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0),
('NORMAL', 'HIGH', 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0),
('CONGESTION', 'LOW', 1.25, 0, 0.85, 0, 1, 0.5, 1, 0.3, 1, 0, 0.985, 0, 1.3, 0),
('CONGESTION', 'MEDIUM', 1.65, 0, 0.65, 0, 1, 1.8, 1, 0.95, 1, -1.5, 0.96, 0, 1.75, 0),
('CONGESTION', 'HIGH', 2.4, 0, 0.4, 0, 1, 4.5, 1, 2.4, 1, -3, 0.91, 0, 2.5, 0),
('SIGNAL_DEGRADATION', 'LOW', 1.2, 0, 0.88, 0, 1, 1.2, 1, 0.5, 1, -10, 0.97, 0, 1, 0),
('SIGNAL_DEGRADATION', 'MEDIUM', 1.6, 0, 0.65, 0, 1, 3.5, 1, 1.5, 1, -22, 0.92, 0, 1, -15),
('SIGNAL_DEGRADATION', 'HIGH', 2.5, 0, 0.35, 0, 1, 8, 1, 3.8, 1, -38, 0.82, 0, 1, -40),
('CELL_OVERLOAD', 'LOW', 1.8, 0, 0.6, 0, 1, 2.2, 1, 1.1, 1, -2, 0.94, 0, 2, 0),
('CELL_OVERLOAD', 'MEDIUM', 3.5, 0, 0.3, 0, 1, 6.5, 1, 3.2, 1, -5, 0.88, 0, 3.5, 0),
('CELL_OVERLOAD', 'HIGH', 8, 0, 0.1, 0, 1, 16, 1, 10.5, 1, -8, 0.75, 0, 6, 0),
('RECOVERY', 'LOW', 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0),
('RECOVERY', 'MEDIUM', 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0),
('RECOVERY', 'HIGH', 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0)"""
# Least and greatest reading, in the order of KPIS.
LIMITS = [(1, 1000), (0, 1200), (0, 100), (0, 100), (-120, -35), (0, 100), (0, 5000)]


def _effects() -> str:
    """The scenario table in SQL: factor and shift per KPI."""
    names = [f"{k}_{part}" for k in KPIS for part in "fd"]
    doubles = ", ".join(f"{n}::DOUBLE AS {n}" for n in names)
    return (f"effects AS (SELECT scenario, severity, {doubles} FROM (VALUES {EFFECT_ROWS}) "
            f"AS v(scenario, severity, {', '.join(names)}))")


def _kpi_limit(k: str, x: str) -> str:
    return _limit(x, *LIMITS[list(KPIS).index(k)])


def _target(k: str) -> str:
    moved = _kpi_limit(k, f"(b.{k}::DOUBLE * {k}_f + {k}_d)")
    return f"CASE WHEN scenario IN ('NORMAL', 'RECOVERY') THEN b.{k}::DOUBLE ELSE {moved} END AS {k}"


TARGETS = ", ".join(_target(k) for k in KPIS)


def _deltas(source: str, keys: str) -> str:
    """Long comparison of b_<kpi> and n_<kpi> columns."""
    parts = []
    for k in KPIS:
        gap = rnd(f"(n_{k} - b_{k})", 3)
        worse = (f"{gap} > 0" if k in health.WORSE_UP else f"{gap} < 0" if k in health.WORSE_DOWN else "FALSE")
        parts.append(
            f"""SELECT {keys}, '{k}' AS metric_key, '{health.DISPLAY_NAMES[k]}' AS metric_name,
  b_{k}::DOUBLE AS baseline, n_{k}::DOUBLE AS simulated, {gap} AS absolute_difference,
  CASE WHEN b_{k} <> 0 THEN {rnd(f"({gap} / abs(b_{k}::DOUBLE) * 100.0::DOUBLE)", 2)}
       WHEN b_{k} = 0 THEN sign({gap}) * 100.0::DOUBLE + 0.0 END AS percentage_difference,
  {worse} AS is_worse FROM {source}""")
    return " UNION ALL ".join(parts)


def _summary_columns(digits) -> str:
    places = {**PLACES, "active_connections": 0}
    mean_places = {**PLACES, "active_connections": 1}
    return ", ".join(
        f"{avg(k, digits[k], mean_places[k], empty=None)} AS avg_{k}, "
        f"{rnd(f'min({k}::DOUBLE)', places[k])} AS min_{k}, {rnd(f'max({k}::DOUBLE)', places[k])} AS max_{k}"
        for k in KPIS)


EVENT_HEALTH_SQL = (f"WITH {EVENTS}, scored AS (SELECT event_id, {_score()} AS health_score FROM obs) "
                    f"SELECT *, {_band('health_score')} AS health_band FROM scored")

SQL = {
    "d1_cell_inventory": f"WITH {OBS} SELECT DISTINCT cell_id, region, technology FROM obs",
    "d1_cell_inventory_filtered": f"WITH {OBS} SELECT DISTINCT cell_id, region, technology FROM obs "
                                  "WHERE lower(region) = 'middle east' AND lower(technology) = 'o'",
    "d1_cell_inventory_match_case": f"WITH {OBS} SELECT DISTINCT cell_id, region, technology FROM obs "
                                    "WHERE region = 'ASIA'",
    "d1_filter_options": f"WITH {OBS} SELECT DISTINCT 'region' AS option, region AS value FROM obs "
                         "UNION SELECT DISTINCT 'technology', technology FROM obs",
    "d2_cell_detail": f"WITH {OBS} SELECT cell_id, region, technology, count(*) AS available_observation_count, "
                      f"{STAMP.format('min(ts)')} AS start_time, {STAMP.format('max(ts)')} AS end_time "
                      "FROM obs GROUP BY ALL",
    "d2_cell_detail_one": f"WITH {OBS} SELECT cell_id, region, technology, count(*) AS available_observation_count, "
                          f"{STAMP.format('min(ts)')} AS start_time, {STAMP.format('max(ts)')} AS end_time "
                          f"FROM obs WHERE cell_id = '{CELL}' GROUP BY ALL",
    "d3_cell_telemetry": f"WITH {OBS} SELECT {TS}, region, cell_id, technology, {_stored()} FROM ("
                         f"SELECT * FROM obs WHERE cell_id = '{CELL}' AND ts >= TIMESTAMP '1996-03-01' "
                         "AND ts <= TIMESTAMP '1999-12-31' ORDER BY ts, technology, "
                         f"{', '.join(KPIS)} LIMIT 200)",
    "d4_cell_summary": f"WITH {OBS} SELECT cell_id, region, technology, count(*) AS observation_count, "
                       f"{_summary_columns(LINE_DIGITS)} FROM obs GROUP BY cell_id, region, technology",
    "d4_cell_summary_long": f"WITH {EVENTS}, wide AS (SELECT cell_id, 'all' AS region, technology, "
                            f"count(*) AS observation_count, {_summary_columns(EVENT_DIGITS)} "
                            "FROM obs GROUP BY cell_id, technology) " + " UNION ALL ".join(
                                f"SELECT cell_id, region, technology, observation_count, '{k}' AS metric_key, "
                                f"min_{k} AS min, max_{k} AS max, avg_{k} AS avg FROM wide" for k in KPIS),
    "d5_missing_cells": "SELECT DISTINCT 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS cell_id "
                        "FROM customer WHERE 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') "
                        "NOT IN (SELECT s_name FROM supplier)",
    "d5_known_cells": "SELECT DISTINCT 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS cell_id "
                      "FROM customer WHERE 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') "
                      "IN (SELECT s_name FROM supplier)",
    "d6_first_baselines": f"WITH {FIRST} SELECT * FROM firsts",
    "d7_baselines_at": f"WITH {OBS}, asked AS (SELECT cell_id AS c, max(ts) AS t FROM obs GROUP BY cell_id) "
                       f"SELECT cell_id, region, technology, {TS}, {_stored()} "
                       "FROM obs JOIN asked ON cell_id = c AND ts = t",
    "g1_health_score": f"WITH {OBS}, scored AS (SELECT cell_id, region, technology, {TS}, {_score()} "
                       f"AS health_score FROM obs) SELECT *, {_band('health_score')} AS health_band FROM scored",
    "g2_alerts": f"WITH {OBS}, timed AS (SELECT *, {TS} FROM obs) "
                 + _alerts("timed", "cell_id, region, technology, timestamp"),
    "g2_alerts_own_thresholds": f"WITH {EVENTS} " + _alerts("obs", "event_id", 1.0, 40.0, 12.5, 85.0),
    "g3_clamped_kpis": f"WITH {OBS} SELECT cell_id, region, technology, {TS}, " + ", ".join(
        f"{_kpi_limit(k, f'({k} * {f}::DOUBLE)')} AS {k}" for k, f in
        {"latency_ms": 10.0, "throughput_mbps": 20.0, "packet_loss_pct": 20.0, "call_drop_rate_pct": 20.0,
         "signal_strength_dbm": 1.5, "handover_success_pct": 1.2, "active_connections": 20.0}.items())
    + " FROM obs",
    "g4_scenario_targets": f"WITH {FIRST}, {_effects()} SELECT cell_id, region, technology, timestamp, "
                           f"scenario, severity, {TARGETS} FROM firsts b, effects",
    "g4_scenario_scores": f"WITH {LINES}, {_effects()}, t AS (SELECT scenario, severity, {TARGETS} "
                          f"FROM lines b, effects), h AS (SELECT scenario, severity, {_score()} AS score FROM t) "
                          "SELECT scenario, severity, count(*) AS observation_count, "
                          f"{avg('score', 1)} AS avg_health_score, "
                          "count(*) FILTER (score < 60) AS critical_count FROM h GROUP BY ALL",
    "g5_scenario_matrix": f"""WITH {FIRST}, {_effects()}, t AS (
  SELECT cell_id, region, technology, timestamp, scenario, {TARGETS} FROM firsts b, effects
  WHERE scenario <> 'RECOVERY' AND severity = 'MEDIUM')
SELECT cell_id, region, technology, timestamp, scenario,
  CASE WHEN scenario = 'NORMAL' THEN 'NONE' ELSE 'MEDIUM' END AS severity, {_stored()},
  {_score()} AS health_score,
  (call_drop_rate_pct > 2)::INT + (latency_ms > 80)::INT + (packet_loss_pct > 3)::INT
    + (handover_success_pct < 90)::INT AS active_alerts_count,
  call_drop_rate_pct > 2 AS high_call_drop_alert FROM t""",
    "g6_scenario_deltas": f"""WITH {FIRST}, {_effects()}, t AS (
  SELECT cell_id, scenario, severity, {", ".join(f"b.{k} AS b_{k}" for k in KPIS)}, {TARGETS}
  FROM firsts b, effects WHERE scenario = 'CELL_OVERLOAD' AND severity = 'HIGH'),
u AS (SELECT cell_id, scenario, severity, {", ".join(f"b_{k}" for k in KPIS)}, {_stored(out="n_")} FROM t)
""" + _deltas("u", "cell_id, scenario, severity"),
    "g7_alert_onsets": f"""WITH {EVENTS}, kinds AS (SELECT *, list_filter([
    CASE WHEN call_drop_rate_pct > 2 THEN 'HIGH_CALL_DROP' END,
    CASE WHEN latency_ms > 80 THEN 'HIGH_LATENCY' END,
    CASE WHEN packet_loss_pct > 3 THEN 'HIGH_PACKET_LOSS' END,
    CASE WHEN handover_success_pct < 90 THEN 'LOW_HANDOVER_SUCCESS' END], lambda x: x IS NOT NULL) AS kinds
  FROM obs),
steps AS (SELECT *, lag(kinds) OVER (PARTITION BY cell_id ORDER BY ts, event_id) AS before FROM kinds),
rows AS ({_alerts("steps", f"cell_id, {TS}, event_id, before")})
SELECT cell_id, timestamp, event_id, alert_type, severity, current_value, threshold, condition_type
FROM rows WHERE before IS NULL OR NOT list_contains(before, alert_type)""",
    "g8_storage_rounding": f"WITH {EVENTS} SELECT event_id, cell_id, technology, {TS}, {_stored()} FROM obs",
    "g9_health_bands": f"WITH {OBS}, s AS (SELECT region, {_score()} AS score FROM obs) "
                       f"SELECT region, {_band('score')} AS health_band, count(*) AS observation_count "
                       "FROM s GROUP BY ALL",
    "g10_adverse_changes": f"""WITH {FIRST}, lasts AS (SELECT cell_id, {_stored(out="n_")} FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY ts DESC, {", ".join(k + " DESC" for k in KPIS)})
    AS back FROM obs) WHERE back = 1),
pairs AS (SELECT f.cell_id, {", ".join(f"f.{k} AS b_{k}" for k in KPIS)}, l.* EXCLUDE (cell_id)
  FROM firsts f JOIN lasts l ON f.cell_id = l.cell_id),
deltas AS ({_deltas("pairs", "cell_id")})
SELECT * EXCLUDE (metric_name) FROM deltas WHERE is_worse""",
}
