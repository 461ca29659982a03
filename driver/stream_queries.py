"""Streaming runs (SURVEY group I) over the given events, compared with the batch SQL."""

from __future__ import annotations

from driver import cube_queries, telemetry_queries
from driver.tables import EVENT_DIGITS, event_kpis, table
from pyspark.sql import functions as F
from starcell.functions.timeparts import stamp_text
from starcell.operators import health
from starcell.session import fresh_path
from starcell.streaming import onsets, telemetry


def _stream(s, d):
    schema = table(s, d, "events").schema
    return telemetry.read_stream(s, f"{d}/events*.parquet", schema)


def _kpis(s, d):
    return event_kpis(s, d, _stream(s, d))


def stream_rollup(s, d):
    out = fresh_path(s, "stream-rollup")
    telemetry.rollup_stream(_kpis(s, d), out, fresh_path(s, "stream-progress"), "hour",
                            digits=EVENT_DIGITS)
    return telemetry.read_rollup(s, out, "hour", EVENT_DIGITS)


def stream_health(s, d):
    """Scores of a stream, counted per band from what it wrote."""
    out = fresh_path(s, "stream-health")
    scored = health.with_health(_kpis(s, d)).select("event_id", "health_score", "health_band")
    telemetry.run_available(scored, fresh_path(s, "stream-progress"), telemetry.append_batches(out))
    return telemetry.read_batches(s, out)


def stream_alerts(s, d):
    out = fresh_path(s, "stream-alerts")
    rows = health.alert_rows(_kpis(s, d), ["event_id"], {
        "latency_ms": 40, "packet_loss_pct": 12.5, "call_drop_rate_pct": 1, "handover_success_pct": 85})
    telemetry.run_available(rows, fresh_path(s, "stream-progress"), telemetry.append_batches(out))
    return telemetry.read_batches(s, out)


def stream_onsets(s, d):
    out = fresh_path(s, "stream-onsets")
    telemetry.onset_stream(_kpis(s, d), out, fresh_path(s, "stream-state"),
                           fresh_path(s, "stream-progress"), tie=["event_id"])
    rows = telemetry.read_onsets(s, out, ["event_id"])
    return rows.withColumn("timestamp", stamp_text(F.col("timestamp"))).drop("message")


def stream_late_onsets(s, d):
    """The same over four micro-batches, each with observations before and after those of the others."""
    folder, out = fresh_path(s, "stream-input"), fresh_path(s, "stream-onsets")
    rows = event_kpis(s, d)
    for part in range(4):
        rows.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(folder)
    stream = telemetry.read_stream(s, folder, rows.schema, files_per_batch=1)
    telemetry.onset_stream(stream, out, fresh_path(s, "stream-state"), fresh_path(s, "stream-progress"),
                           tie=["event_id"])
    rows = telemetry.read_onsets(s, out, ["event_id"])
    return rows.withColumn("timestamp", stamp_text(F.col("timestamp"))).drop("message")


# Observations of the keyed stream come up to two days late.
LATE_DAYS, DELAY = 2, "3 days"


def stream_keyed_onsets(s, d):
    """From keyed state, over files of about a week each; the last three days wait for the watermark."""
    folder, staged, out = (fresh_path(s, name) for name in ("stream-input", "stream-weeks", "stream-onsets"))
    rows = event_kpis(s, d)
    arrived = F.unix_date(F.col("timestamp").cast("date")) + F.pmod(F.col("event_id"), F.lit(LATE_DAYS + 1))
    rows = rows.withColumn("week", F.floor(arrived / 7))
    rows.write.partitionBy("week").parquet(staged)
    schema = rows.drop("week").schema
    for week in sorted(r["week"] for r in rows.select("week").distinct().collect()):
        s.read.schema(schema).parquet(f"{staged}/week={week}").coalesce(1).write.mode("append").parquet(folder)
    stream = telemetry.read_stream(s, folder, schema, files_per_batch=1)
    onsets.keyed_onset_stream(stream, out, fresh_path(s, "stream-progress"), DELAY, tie=["event_id"])
    rows = telemetry.read_batches(s, out)
    return rows.withColumn("timestamp", stamp_text(F.col("timestamp"))).drop("message")


QUERIES = {
    "c2_stream_rollup_hour": stream_rollup,
    "g1_stream_health": stream_health,
    "g2_stream_alerts": stream_alerts,
    "g7_stream_onsets": stream_onsets,
    "g7_stream_late_onsets": stream_late_onsets,
    "g7_stream_keyed_onsets": stream_keyed_onsets,
}

SQL = {
    "c2_stream_rollup_hour": cube_queries.SQL["c2_network_rollup_hour"],
    "g1_stream_health": telemetry_queries.EVENT_HEALTH_SQL,
    "g2_stream_alerts": telemetry_queries.SQL["g2_alerts_own_thresholds"],
    "g7_stream_onsets": telemetry_queries.SQL["g7_alert_onsets"],
    "g7_stream_late_onsets": telemetry_queries.SQL["g7_alert_onsets"],
    # Without the observations that the watermark has not passed.
    "g7_stream_keyed_onsets": telemetry_queries.SQL["g7_alert_onsets"].replace(
        "WHERE before", "WHERE timestamp < (SELECT strftime(max(ts) - INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') FROM events) "
        "AND (before") + ")",
}
