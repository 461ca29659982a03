"""A stream of several files gives what the batch operators give."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driver.tables import EVENT_DIGITS, event_cube, event_kpis
from starcell.operators import health
from starcell.plans.marts import KPIS
from starcell.streaming import onsets, telemetry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in time order as four files, made one after the other."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = event_kpis(spark, SF_DIR)
    edges = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01"]
    for low, high in zip(edges, edges[1:]):
        part = rows.where((F.col("timestamp") >= F.lit(low).cast("timestamp_ntz"))
                          & (F.col("timestamp") < F.lit(high).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return telemetry.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def lines(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("level", ["hour", "week"])
def test_rollup(spark, folder, tmp_path, level):
    telemetry.rollup_stream(stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "progress"), level,
                            digits=EVENT_DIGITS)
    assert lines(telemetry.read_rollup(spark, str(tmp_path / "out"), level, EVENT_DIGITS)) == lines(
        event_cube(spark, SF_DIR).rollup(level))


def test_alerts(spark, folder, tmp_path):
    rows = health.alert_rows(stream(spark, folder), ["event_id"])
    telemetry.run_available(rows, str(tmp_path / "progress"), telemetry.append_batches(str(tmp_path / "out")))
    assert lines(telemetry.read_batches(spark, str(tmp_path / "out"))) == lines(
        health.alert_rows(event_kpis(spark, SF_DIR), ["event_id"]))


def test_onsets_and_restart(spark, folder, tmp_path):
    places = [str(tmp_path / n) for n in ("out", "state", "progress")]
    for _ in range(2):  # the second run finds nothing new
        telemetry.onset_stream(stream(spark, folder), *places, tie=["event_id"])
    assert lines(telemetry.read_onsets(spark, places[0], ["event_id"])) == lines(
        health.alert_onsets(event_kpis(spark, SF_DIR), tie=["event_id"]))


def test_late_readings_change_earlier_onsets(spark, tmp_path):
    schema = event_kpis(spark, SF_DIR).select("cell_id", "timestamp", *KPIS).schema
    quiet = {"latency_ms": 10.0, "throughput_mbps": 1.0, "packet_loss_pct": 0.0, "call_drop_rate_pct": 0.0,
             "signal_strength_dbm": -60.0, "handover_success_pct": 99.0, "active_connections": 1}
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    folder = str(tmp_path / "in")
    batches = [[("a", 1, 90.0), ("a", 3, 90.0), (None, 1, 90.0)], [("a", 2, 90.0), (None, 30, 90.0)],
               [("a", 0, 90.0), ("b", 5, 90.0)], [("a", 2.5, 10.0)]]
    for rows in batches:
        spark.createDataFrame([(c, at(h), *(quiet | {"latency_ms": v}).values()) for c, h, v in rows], schema) \
            .coalesce(1).write.mode("append").parquet(folder)
    places = [str(tmp_path / n) for n in ("out", "state", "progress")]
    telemetry.onset_stream(telemetry.read_stream(spark, folder, schema, files_per_batch=1), *places)
    got = telemetry.read_onsets(spark, places[0])
    assert lines(got) == lines(health.alert_onsets(spark.read.parquet(folder)))
    assert sorted((str(r.cell_id), r.timestamp) for r in got.collect()) == [("None", at(1)), ("a", at(0)), ("a", at(3)), ("b", at(5))]


QUIET = {"latency_ms": 10.0, "throughput_mbps": 1.0, "packet_loss_pct": 0.0, "call_drop_rate_pct": 0.0,
         "signal_strength_dbm": -60.0, "handover_success_pct": 99.0, "active_connections": 1}


def written(spark, folder, batches):
    """One file per batch of (cell, minute, tie, latency); its schema."""
    base = spark.range(0).select(F.lit(None).cast("string").alias("cell_id"),
                                 F.lit(None).cast("timestamp_ntz").alias("timestamp"),
                                 F.lit(None).cast("bigint").alias("n"),
                                 *[F.lit(None).cast("int" if k == "active_connections" else "double").alias(k) for k in KPIS])
    for rows in batches:
        lines_ = [(c, None if m is None else datetime(2024, 1, 1) + timedelta(minutes=m), n,
                   *[v if k == "latency_ms" else QUIET[k] for k in KPIS]) for c, m, n, v in rows]
        spark.createDataFrame(lines_, base.schema).coalesce(1).write.mode("append").parquet(folder)
    return base.schema


def keyed(spark, folder, schema, tmp_path, delay):
    out = str(tmp_path / "out")
    onsets.keyed_onset_stream(telemetry.read_stream(spark, folder, schema, files_per_batch=1), out,
                              str(tmp_path / "progress"), delay, tie=["n"])
    return telemetry.read_batches(spark, out)


def test_keyed_onsets_within_the_watermark(spark, tmp_path):
    """Batches whose rows come up to nine minutes late give what the batch operator gives."""
    rng = np.random.default_rng(5)
    rows = [(["a", "b", None][rng.integers(3)], int(m), int(2**60 + i) if i % 7 else None, float(rng.choice([10, 90, 200])))
            for i, m in enumerate(np.sort(rng.integers(0, 500, 900)))]
    batches = [[] for _ in range(50)]
    for row in rows:
        batches[min((row[1] + int(rng.integers(0, 10))) // 10, 49)].append(row)
    folder = str(tmp_path / "in")
    schema = written(spark, folder, [b for b in batches if b])
    got = keyed(spark, folder, schema, tmp_path, "10 minutes")
    end = datetime(2024, 1, 1) + timedelta(minutes=max(r[1] for r in rows) - 10)
    want = health.alert_onsets(spark.read.parquet(folder), tie=["n"]).where(F.col("timestamp") < F.lit(end))
    # Rows that agree in cell, time and tie have no order of their own.
    assert got.count() > 100 and lines(got) == lines(want)


def test_keyed_onsets_leave_out_what_is_too_late(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = written(spark, folder, [
        [("a", 0, 1, 90.0), ("a", 2, 1, 10.0), ("b", 30, 1, 10.0), ("b", None, 1, 90.0)],
        [("b", 31, 1, 10.0)],
        [("a", 1, 1, 10.0), ("a", 40, 1, None), ("a", 41, 1, 90.0)],  # minute 1 has been decided
        [("b", 80, 1, 10.0)]])
    got = keyed(spark, folder, schema, tmp_path, "5 minutes")
    assert sorted((r.cell_id, r.timestamp.minute) for r in got.collect()) == [("a", 0), ("a", 41)]
    # A second run has nothing new, and resumes from its state.
    assert keyed(spark, folder, schema, tmp_path, "5 minutes").count() == 2
    written(spark, folder, [[("a", 79, 1, 90.0), ("b", 79, 1, 90.0)], [("b", 120, 1, 10.0)]])
    got = keyed(spark, folder, schema, tmp_path, "5 minutes")
    assert sorted((r.cell_id, r.timestamp.minute + 60 * r.timestamp.hour) for r in got.collect()) == [("a", 0), ("a", 41), ("b", 79)]


def test_keyed_onsets_of_many_cells(spark, tmp_path):
    """Many cells share a few buckets; each follows its own last observation from batch to batch."""
    rng = np.random.default_rng(7)
    batches = [[(f"c{i}" if i else None, 60 * hour + int(rng.integers(0, 60)), hour, float(rng.choice([10, 90, 200])))
                for i in range(600)] for hour in range(3)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = written(spark, folder, [*batches, [("end", 300, 9, 10.0)]])
    onsets.keyed_onset_stream(telemetry.read_stream(spark, folder, schema, files_per_batch=1), out,
                              str(tmp_path / "progress"), "60 minutes", tie=["n"], buckets=5)
    want = health.alert_onsets(spark.read.parquet(folder), tie=["n"]).where("n < 9")
    got = telemetry.read_batches(spark, out)
    assert got.count() > 500 and lines(got) == lines(want)


def test_state_calls_do_not_grow_with_the_cells():
    """One bucket with many cells is read and written a few times, not once per cell."""
    calls = []

    class State:
        def __init__(self, single):
            self.single, self.held = single, None if single else []

        def get(self):
            calls.append("get")
            return self.held if self.single else iter(self.held)

        def update(self, value):
            calls.append("update")
            self.held = value

        def put(self, values):
            calls.append("put")
            self.held = list(values)

        def appendValue(self, value):
            calls.append("append")
            self.held.append(value)

        def clear(self):
            calls.append("clear")
            self.held = None if self.single else []

    handle = SimpleNamespace(getListState=lambda *a: State(False), getValueState=lambda *a: State(True),
                             registerTimer=lambda ms: calls.append("timer"), deleteTimer=lambda ms: calls.append("timer"))
    fields = "cell string, at bigint, tie0_has int, tie0 bigint, latency_ms double, active int"
    processor = onsets.OnsetProcessor(StructType.fromDDL(fields), ["at", "tie0_has", "tie0"])
    processor.init(handle)
    found = []
    for step, active in enumerate((1, 3, 0)):
        rows = pd.DataFrame({"cell": [f"c{i}" for i in range(2000)], "at": (step + 1) * 1_000_000, "tie0_has": 1,
                             "tie0": 1, "latency_ms": 90.0, "active": active}).astype({"tie0_has": "int32", "active": "int32"})
        list(processor.handleInputRows((1,), iter([rows]), None))
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda at=step: (at + 1) * 1000 + 500)
        found += [len(part) for part in processor.handleExpiredTimer((1,), clock, None)]
    assert found == [2000, 2000] and len(calls) < 40
    assert processor.last.held is None and not processor.rows.held


def test_keyed_onsets_refuse_other_ties(spark, folder):
    with pytest.raises(ValueError, match="ties"):
        onsets.keyed_onsets(stream(spark, folder), tie=["latency_ms"])
