from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from starcell.operators import health
from starcell.operators.telemetry import storage_rounding
from starcell.plans.marts import KPIS
from tests.samples import CELL_25, observations, readings

# Every bound: a reading below, on and above it.
CLAMPS = [(kpi, (int if kpi == "active_connections" else float)(edge + side * step),
           min(max(edge + side * step, low), high))
          for kpi, (low, high) in health.BOUNDS.items() for edge in (low, high)
          for side in (-1, 0, 1) for step in ((high - low) / 8,)]


def score(df):
    return health.with_health(df).first().health_score


@pytest.mark.parametrize("kpi,value,limited", CLAMPS)
def test_clamps(spark, kpi, value, limited):
    assert health.clamp_kpis(readings(spark, **{kpi: value})).first()[kpi] == limited


def penalised(**past):
    """What readings this far past their limits are to score, from the table of penalties."""
    lost = sum(min(past[k] * abs(rate), most) for k, (_, rate, most, _) in health.PENALTIES.items() if k in past)
    return {k: fine + past.get(k, 0.0) * (1 if rate > 0 else -1) for k, (fine, rate, *_) in health.PENALTIES.items()}, \
        round(max(0.0, 100.0 - lost), 1)


@pytest.mark.parametrize("past", [
    {}, {"latency_ms": 12.0}, {"call_drop_rate_pct": 1.5, "signal_strength_dbm": 8.0},
    {"packet_loss_pct": 3.0, "handover_success_pct": 4.0, "latency_ms": 30.0},
    dict.fromkeys(health.PENALTIES, 45.0)])
def test_scores_follow_the_penalties(spark, past):
    values, want = penalised(**past)
    assert score(readings(spark, **values)) == want


def test_documented_score(spark):
    assert score(readings(spark)) == 89.2


def test_missing_kpis_take_defaults(spark):
    assert score(readings(spark, latency_ms=None, packet_loss_pct=None, call_drop_rate_pct=None,
                          signal_strength_dbm=None, handover_success_pct=None)) == 100.0
    assert score(readings(spark).select("cell_id", "call_drop_rate_pct")) == 93.9


def kinds(df, **limits):
    return {r.alert_type: r.severity for r in health.alert_rows(df, ["cell_id"], limits).collect()}


def test_alert_edges(spark):
    assert kinds(readings(spark, call_drop_rate_pct=2.0)) == {}
    assert kinds(readings(spark, call_drop_rate_pct=2.5)) == {"HIGH_CALL_DROP": "WARNING"}
    assert kinds(readings(spark, call_drop_rate_pct=5.0)) == {"HIGH_CALL_DROP": "CRITICAL"}
    assert kinds(readings(spark, latency_ms=80.0)) == {}
    assert kinds(readings(spark, latency_ms=159.9)) == {"HIGH_LATENCY": "WARNING"}
    assert kinds(readings(spark, latency_ms=160.0)) == {"HIGH_LATENCY": "CRITICAL"}
    assert kinds(readings(spark, packet_loss_pct=3.0)) == {}
    assert kinds(readings(spark, packet_loss_pct=6.0)) == {"HIGH_PACKET_LOSS": "CRITICAL"}
    assert kinds(readings(spark, handover_success_pct=90.0)) == {}
    assert kinds(readings(spark, handover_success_pct=80.0)) == {"LOW_HANDOVER_SUCCESS": "WARNING"}
    assert kinds(readings(spark, handover_success_pct=79.9)) == {"LOW_HANDOVER_SUCCESS": "CRITICAL"}
    assert kinds(readings(spark, latency_ms=None, handover_success_pct=None)) == {}
    assert kinds(readings(spark), call_drop_rate_pct=0.5) == {"HIGH_CALL_DROP": "WARNING"}


def test_alert_text(spark):
    row = health.alert_rows(readings(spark, latency_ms=95.25), ["cell_id"]).first()
    assert row.message == "Simulated round-trip latency (95.3 ms) exceeds operational ceiling (80 ms)."
    assert row.current_value == 95.25 and row.threshold == 80.0


def test_unknown_threshold(spark):
    with pytest.raises(ValueError):
        health.alerts({"throughput_mbps": 5})


def target(spark, name, level, **changes):
    return health.scenario_targets(readings(spark, **changes), [name], [level]).first()


def test_scenarios_move_the_documented_way(spark):
    row = target(spark, "congestion", "high")
    assert row.active_connections == 395 * 2.5 and row.latency_ms == 3.73 * 2.4
    assert row.call_drop_rate_pct == 0.607 + 2.4
    for name in ("CONGESTION", "SIGNAL_DEGRADATION", "CELL_OVERLOAD"):
        drops = [target(spark, name, level).call_drop_rate_pct for level in health.SEVERITIES]
        assert 0.607 < drops[0] < drops[1] < drops[2]


def test_unchanged_scenarios_are_not_limited(spark):
    assert target(spark, "NORMAL", "LOW", latency_ms=2000.0).latency_ms == 2000.0
    assert target(spark, "RECOVERY", "HIGH", latency_ms=2000.0).latency_ms == 2000.0
    assert target(spark, "CONGESTION", "LOW", latency_ms=2000.0).latency_ms == 1000.0


def test_unknown_scenario(spark):
    for names, levels in ((["STORM"], ["LOW"]), (["NORMAL"], ["NONE"])):
        with pytest.raises(ValueError):
            health.scenario_targets(readings(spark), names, levels)


def test_matrix(spark):
    rows = health.scenario_matrix(readings(spark), "HIGH").collect()
    assert [(r.scenario, r.severity) for r in rows] == [
        ("NORMAL", "NONE"), ("CONGESTION", "HIGH"), ("SIGNAL_DEGRADATION", "HIGH"), ("CELL_OVERLOAD", "HIGH")]
    assert rows[0].health_score == 89.2 and rows[0].active_alerts_count == 0
    assert all(r.health_score < 89.2 and r.high_call_drop_alert for r in rows[1:])
    assert rows[1].active_connections == 987


# A documented comparison.
DELTAS = {
    "latency_ms": (8.91, 5.18, 138.87), "throughput_mbps": (116.65, -172.51, -59.66),
    "packet_loss_pct": (5.643, 4.464, 378.63), "call_drop_rate_pct": (2.987, 2.38, 392.09),
    "signal_strength_dbm": (-66.68, -2.98, -4.68), "handover_success_pct": (88.53, -8.68, -8.93),
    "active_connections": (983.0, 588.0, 148.86),
}


def test_documented_deltas(spark):
    base = readings(spark).select("cell_id", *[F.col(k).alias(f"baseline_{k}") for k in KPIS])
    now = base.select("*", *[F.lit(v[0]).alias(f"simulated_{k}") for k, v in DELTAS.items()])
    for row in health.compare_kpis(now, ["cell_id"]).collect():
        _, gap, percent = DELTAS[row.metric_key]
        assert (row.absolute_difference, row.percentage_difference) == (gap, percent)
        assert row.is_worse == (row.metric_key != "active_connections")


@pytest.mark.parametrize("now,percent", [(0.0, 0.0), (3.0, 100.0), (-3.0, -100.0)])
def test_zero_baseline(spark, now, percent):
    pair = readings(spark).select("cell_id", *[F.lit(0.0).alias(f"baseline_{k}") for k in KPIS],
                                  *[F.lit(now).alias(f"simulated_{k}") for k in KPIS])
    assert {r.percentage_difference for r in health.compare_kpis(pair, ["cell_id"]).collect()} == {percent}


def test_storage_rounding(spark):
    row = storage_rounding(readings(spark, latency_ms=1.239, packet_loss_pct=0.12345)).first()
    assert row.latency_ms == 1.24 and row.packet_loss_pct == 0.123 and row.active_connections == 395


def telemetry_of(spark, drops, step=timedelta(hours=7)):
    start = datetime(2026, 8, 3, 14)
    base = list(CELL_25)
    out = []
    for place, drop in enumerate(drops):
        row = list(base)
        row[3], row[7] = start + step * place, drop
        out.append(tuple(row))
    return observations(spark, out)


def test_onsets_across_days(spark):
    """Seven-hour steps cross midnight, and one gap skips a day."""
    drops = [0.5, 3.0, 3.0, 3.0, 0.5, 4.0, 4.0, 0.1, 9.0]
    for step in (timedelta(hours=7), timedelta(minutes=1), timedelta(days=3)):
        rows = health.alert_onsets(telemetry_of(spark, drops, step)).orderBy("timestamp").collect()
        assert [r.current_value for r in rows] == [3.0, 4.0, 9.0]


def test_onset_of_the_first_observation(spark):
    assert health.alert_onsets(telemetry_of(spark, [6.0])).count() == 1
