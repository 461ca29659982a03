"""Health score, alerts and what-if scenarios as projections over whole facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcell.functions import arguments
from starcell.functions.labels import health_band
from starcell.functions.numeric import as_column, clamp, fixed_text, round_half_up
from starcell.operators.telemetry import storage_rounding
from starcell.plans.marts import KPIS

# Per KPI the reading that costs nothing, the points lost per unit
# beyond it, the most points it can cost, and the reading assumed when missing.
# A negative rate means that lower readings are worse.
PENALTIES = {
    "call_drop_rate_pct": (0.0, 10.0, 30.0, 0.0),
    "packet_loss_pct": (0.0, 4.0, 20.0, 0.0),
    "latency_ms": (20.0, 0.25, 20.0, 20.0),
    "signal_strength_dbm": (-70.0, -0.5, 15.0, -55.0),
    "handover_success_pct": (96.0, -1.5, 15.0, 98.0),
}

# Default alert thresholds, the last one a floor.
THRESHOLDS = {
    "call_drop_rate_pct": 2.0,
    "latency_ms": 80.0,
    "packet_loss_pct": 3.0,
    "handover_success_pct": 90.0,
}

# Physical bounds of each KPI.
BOUNDS = {
    "latency_ms": (1.0, 1000.0),
    "throughput_mbps": (0.0, 1200.0),
    "packet_loss_pct": (0.0, 100.0),
    "call_drop_rate_pct": (0.0, 100.0),
    "signal_strength_dbm": (-120.0, -35.0),
    "handover_success_pct": (0.0, 100.0),
    "active_connections": (0.0, 5000.0),
}

# What each scenario does to a baseline, as (factor, shift) per KPI.
# A KPI that is not named stays as it is.
SCENARIOS = {
    ("CONGESTION", "LOW"): {
        "active_connections": (1.30, 0.0), "latency_ms": (1.25, 0.0),
        "throughput_mbps": (0.85, 0.0), "handover_success_pct": (0.985, 0.0),
        "packet_loss_pct": (1.0, 0.50), "call_drop_rate_pct": (1.0, 0.30),
    },
    ("CONGESTION", "MEDIUM"): {
        "active_connections": (1.75, 0.0), "latency_ms": (1.65, 0.0),
        "throughput_mbps": (0.65, 0.0), "handover_success_pct": (0.96, 0.0),
        "packet_loss_pct": (1.0, 1.80), "call_drop_rate_pct": (1.0, 0.95),
        "signal_strength_dbm": (1.0, -1.5),
    },
    ("CONGESTION", "HIGH"): {
        "active_connections": (2.50, 0.0), "latency_ms": (2.40, 0.0),
        "throughput_mbps": (0.40, 0.0), "handover_success_pct": (0.91, 0.0),
        "packet_loss_pct": (1.0, 4.50), "call_drop_rate_pct": (1.0, 2.40),
        "signal_strength_dbm": (1.0, -3.0),
    },
    ("SIGNAL_DEGRADATION", "LOW"): {
        "throughput_mbps": (0.88, 0.0), "latency_ms": (1.20, 0.0),
        "handover_success_pct": (0.97, 0.0), "signal_strength_dbm": (1.0, -10.0),
        "packet_loss_pct": (1.0, 1.20), "call_drop_rate_pct": (1.0, 0.50),
    },
    ("SIGNAL_DEGRADATION", "MEDIUM"): {
        "throughput_mbps": (0.65, 0.0), "latency_ms": (1.60, 0.0),
        "handover_success_pct": (0.92, 0.0), "signal_strength_dbm": (1.0, -22.0),
        "packet_loss_pct": (1.0, 3.50), "call_drop_rate_pct": (1.0, 1.50),
        "active_connections": (1.0, -15.0),
    },
    ("SIGNAL_DEGRADATION", "HIGH"): {
        "throughput_mbps": (0.35, 0.0), "latency_ms": (2.50, 0.0),
        "handover_success_pct": (0.82, 0.0), "signal_strength_dbm": (1.0, -38.0),
        "packet_loss_pct": (1.0, 8.00), "call_drop_rate_pct": (1.0, 3.80),
        "active_connections": (1.0, -40.0),
    },
    ("CELL_OVERLOAD", "LOW"): {
        "active_connections": (2.00, 0.0), "latency_ms": (1.80, 0.0),
        "throughput_mbps": (0.60, 0.0), "handover_success_pct": (0.94, 0.0),
        "packet_loss_pct": (1.0, 2.20), "call_drop_rate_pct": (1.0, 1.10),
        "signal_strength_dbm": (1.0, -2.0),
    },
    ("CELL_OVERLOAD", "MEDIUM"): {
        "active_connections": (3.50, 0.0), "latency_ms": (3.50, 0.0),
        "throughput_mbps": (0.30, 0.0), "handover_success_pct": (0.88, 0.0),
        "packet_loss_pct": (1.0, 6.50), "call_drop_rate_pct": (1.0, 3.20),
        "signal_strength_dbm": (1.0, -5.0),
    },
    ("CELL_OVERLOAD", "HIGH"): {
        "active_connections": (6.00, 0.0), "latency_ms": (8.00, 0.0),
        "throughput_mbps": (0.10, 0.0), "handover_success_pct": (0.75, 0.0),
        "packet_loss_pct": (1.0, 16.00), "call_drop_rate_pct": (1.0, 10.50),
        "signal_strength_dbm": (1.0, -8.0),
    },
}
UNCHANGED = ("NORMAL", "RECOVERY")
SCENARIO_NAMES = ("NORMAL", "CONGESTION", "SIGNAL_DEGRADATION", "CELL_OVERLOAD", "RECOVERY")
SEVERITIES = ("LOW", "MEDIUM", "HIGH")

# Names of the KPIs in results.
DISPLAY_NAMES = {
    "latency_ms": "Latency (ms)",
    "throughput_mbps": "Throughput (Mbps)",
    "packet_loss_pct": "Packet Loss (%)",
    "call_drop_rate_pct": "Call Drop Rate (%)",
    "signal_strength_dbm": "Signal Strength (dBm)",
    "handover_success_pct": "Handover Success (%)",
    "active_connections": "Active Connections",
}

# Direction in which a change is bad; KPIs not named have none.
WORSE_UP = ("latency_ms", "call_drop_rate_pct", "packet_loss_pct")
WORSE_DOWN = ("throughput_mbps", "signal_strength_dbm", "handover_success_pct")


def health_score(columns: Sequence[str] = tuple(PENALTIES)) -> Column:
    """100 minus the capped penalties of five KPIs, one decimal.

    `columns` are those the frame has; a missing or NULL KPI takes its default.
    """
    lost = F.lit(0.0)
    for kpi, (fine, rate, most, default) in PENALTIES.items():
        reading = F.coalesce(F.col(kpi).cast("double"), F.lit(default)) if kpi in columns else F.lit(default)
        beyond = reading - fine if rate > 0 else fine - reading
        lost = lost + clamp(beyond * abs(rate), 0.0, most)
    return round_half_up(clamp(100.0 - lost, 0.0, 100.0), 1)


def with_health(df: DataFrame) -> DataFrame:
    """Adds health_score and its band."""
    scored = df.withColumn("health_score", health_score(df.columns))
    return scored.withColumn("health_band", health_band("health_score"))


# Each alert's KPI, the message around its reading and its threshold,
# and the decimals of reading, threshold and stored value.
ALERTS = {
    "HIGH_CALL_DROP": ("call_drop_rate_pct", "Simulated call drop rate (", "%) exceeds analytical threshold (",
                       "%).", 2, 1, 3),
    "HIGH_LATENCY": ("latency_ms", "Simulated round-trip latency (", " ms) exceeds operational ceiling (",
                     " ms).", 1, 0, 2),
    "HIGH_PACKET_LOSS": ("packet_loss_pct", "Simulated IP packet loss (", "%) exceeds tolerance (",
                         "%).", 2, 1, 3),
    "LOW_HANDOVER_SUCCESS": ("handover_success_pct", "Simulated inter-cell handover success (",
                             "%) dropped below threshold (", "%).", 1, 0, 2),
}
# Multiple of the threshold from which a high reading is critical, and
# the margin below the threshold under which a low one is.
CRITICAL_MULTIPLES = {"HIGH_CALL_DROP": 2.5, "HIGH_LATENCY": 2.0, "HIGH_PACKET_LOSS": 2.0}
CRITICAL_MARGIN = 10.0


def _limits(thresholds: Mapping[str, float] | None) -> dict[str, float]:
    limits = dict(THRESHOLDS)
    for name, value in (thresholds or {}).items():
        limits[arguments.pick(name, THRESHOLDS, "alert threshold")] = arguments.number(value, name)
    return limits


def _kinds(columns: Sequence[str]) -> list[str]:
    """The alert kinds whose KPI is at hand."""
    return [kind for kind, (kpi, *_) in ALERTS.items() if kpi in columns]


def alert_kpis(columns: Sequence[str]) -> list[str]:
    """The KPIs at hand that alerts are about."""
    return [ALERTS[kind][0] for kind in _kinds(columns)]


def _past(kind: str, limits: Mapping[str, float]) -> Column:
    """Whether the reading is past the limit of this kind."""
    kpi = ALERTS[kind][0]
    value = F.col(kpi).cast("double")
    return value > limits[kpi] if kind in CRITICAL_MULTIPLES else value < limits[kpi]


def _alert(kind: str, limits: Mapping[str, float], raised: Column) -> Column:
    """The alert struct where it is raised, else NULL."""
    kpi, before, between, after, shown, shown_limit, stored = ALERTS[kind]
    value, limit = F.col(kpi).cast("double"), limits[kpi]
    if kind in CRITICAL_MULTIPLES:
        critical = value >= limit * CRITICAL_MULTIPLES[kind]
    else:
        critical = value < limit - CRITICAL_MARGIN
    ending = f"{between}{limit:.{shown_limit}f}{after}"
    return F.when(raised, F.struct(
        F.lit(kind).alias("alert_type"),
        F.when(critical, F.lit("CRITICAL")).otherwise(F.lit("WARNING")).alias("severity"),
        round_half_up(value, stored).alias("current_value"),
        F.lit(limit).alias("threshold"),
        F.lit("SIMULATED CONDITION").alias("condition_type"),
        F.concat(F.lit(before), fixed_text(value, shown), F.lit(ending)).alias("message"),
    ))


def _found(thresholds: Mapping[str, float] | None, columns: Sequence[str]) -> Column:
    """Array with one struct or NULL per alert kind."""
    limits = _limits(thresholds)
    return F.array(*[_alert(kind, limits, _past(kind, limits)) for kind in _kinds(columns)])


def active_alerts(columns: Sequence[str], thresholds: Mapping[str, float] | None = None) -> Column:
    """The alert kinds that an observation raises, a bit per kind."""
    limits = _limits(thresholds)
    return sum((F.when(_past(kind, limits), 2**place).otherwise(0)
                for place, kind in enumerate(_kinds(columns))), F.lit(0))


def new_alerts(columns: Sequence[str], active: Column, before: Column,
               thresholds: Mapping[str, float] | None = None) -> Column:
    """Array with one struct or NULL per alert kind: those in `active` but not in `before`."""
    limits = _limits(thresholds)
    fresh = active.bitwiseAND(F.bitwise_not(before))
    return F.array(*[_alert(kind, limits, fresh.bitwiseAND(F.lit(2**place)) != 0)
                     for place, kind in enumerate(_kinds(columns))])


def alerts(thresholds: Mapping[str, float] | None = None, columns: Sequence[str] = tuple(KPIS)) -> Column:
    """Array of alert structs of one observation, in a fixed order.

    A KPI the frame lacks, or a NULL one, raises no alert.
    """
    return F.array_compact(_found(thresholds, columns))


def alert_rows(df: DataFrame, keys: Sequence[str], thresholds: Mapping[str, float] | None = None,
               ) -> DataFrame:
    """One row per alert, with the given columns of its observation."""
    rows = df.select(*keys, F.inline(_found(thresholds, df.columns)))
    return rows.where(F.col("alert_type").isNotNull())


def clamp_kpis(df: DataFrame) -> DataFrame:
    """Every KPI limited to its physical bounds."""
    return df.withColumns({k: clamp(F.col(k).cast("double"), *BOUNDS[k])
                           for k in KPIS if k in df.columns})


def _scenario_pairs(scenarios: Sequence[str], severities: Sequence[str]) -> list[tuple[str, str]]:
    names = [str(s).strip().upper() for s in scenarios]
    levels = [str(s).strip().upper() for s in severities]
    for given, allowed, what in ((names, SCENARIO_NAMES, "scenario"), (levels, SEVERITIES, "severity")):
        unknown = sorted(set(given) - set(allowed))
        if unknown:
            raise ValueError(f"unknown {what} {unknown}; expected one of {list(allowed)}")
    return [(n, s) for n in names for s in levels]


def scenario_targets(df: DataFrame, scenarios: Sequence[str] = SCENARIO_NAMES,
                     severities: Sequence[str] = SEVERITIES) -> DataFrame:
    """Each observation under each scenario and severity.

    The effects are one literal table exploded in the row, so no join is involved. A
    scenario without effects returns the reading itself, out of bounds or not.
    """
    pairs = _scenario_pairs(scenarios, severities)
    table = F.array(*[F.struct(
        F.lit(name).alias("scenario"), F.lit(level).alias("severity"),
        *[F.lit(x).alias(f"{kpi}_{part}") for kpi in KPIS for part, x in zip(
            ("factor", "shift"), SCENARIOS.get((name, level), {}).get(kpi, (1.0, 0.0)))])
        for name, level in pairs])
    keys = [c for c in df.columns if c not in KPIS]
    rows = df.select(*keys, *KPIS, F.explode(table).alias("__e"))
    as_is = F.col("__e.scenario").isin(*UNCHANGED)
    targets = []
    for kpi in KPIS:
        value = F.col(kpi).cast("double")
        moved = clamp(value * F.col(f"__e.{kpi}_factor") + F.col(f"__e.{kpi}_shift"), *BOUNDS[kpi])
        targets.append(F.when(as_is, value).otherwise(moved).alias(kpi))
    return rows.select(*keys, "__e.scenario", "__e.severity", *targets)


def scenario_matrix(baselines: DataFrame, severity: str = "MEDIUM",
                    thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """KPIs, score and alerts of every baseline under the four static scenarios."""
    rows = scenario_targets(baselines, SCENARIO_NAMES[:4], [severity])
    kinds = F.col("__alerts")["alert_type"]
    rows = rows.withColumn("health_score", health_score(rows.columns)).withColumn(
        "__alerts", alerts(thresholds, rows.columns))
    rows = rows.withColumns({
        "severity": F.when(F.col("scenario") == "NORMAL", F.lit("NONE")).otherwise(F.col("severity")),
        "active_alerts_count": F.size("__alerts"),
        "high_call_drop_alert": F.array_contains(kinds, "HIGH_CALL_DROP"),
    }).drop("__alerts")
    return storage_rounding(rows)


def compare_kpis(pairs: DataFrame, keys: Sequence[str], baseline: str = "baseline_",
                 other: str = "simulated_") -> DataFrame:
    """Baseline against another reading, one row per KPI.

    `pairs` holds both readings side by side under two prefixes, so the long form
    needs no join. A baseline of zero has no percentage: it shows 0 or +-100.
    """
    entries = []
    for kpi in KPIS:
        base, now = (F.col(p + kpi).cast("double") for p in (baseline, other))
        entries.append(F.struct(F.lit(kpi).alias("metric_key"), F.lit(DISPLAY_NAMES[kpi]).alias("metric_name"),
                                base.alias("baseline"), now.alias("simulated"),
                                round_half_up(now - base, 3).alias("absolute_difference")))
    rows = pairs.select(*keys, F.inline(F.array(*entries)))
    gap, base = F.col("absolute_difference"), F.col("baseline")
    percent = F.when(base != 0.0, round_half_up(F.try_divide(gap, F.abs(base)) * 100.0, 2)).when(
        base == 0.0, F.signum(gap) * 100.0 + 0.0)
    return rows.withColumn("percentage_difference", percent).withColumn("is_worse", is_worse())


def is_worse(metric: str = "metric_key", change: str = "absolute_difference") -> Column:
    """Whether the change of a KPI is in its bad direction."""
    metric, change = as_column(metric), as_column(change)
    return (metric.isin(*WORSE_UP) & (change > 0)) | (metric.isin(*WORSE_DOWN) & (change < 0))


def compare_scenario(baselines: DataFrame, scenario: str, severity: str = "MEDIUM") -> DataFrame:
    """Deltas between each stored baseline and its target under one scenario."""
    keys = [c for c in baselines.columns if c not in KPIS]
    rounded = storage_rounding(baselines)
    both = rounded.select(*keys, *KPIS, *[F.col(k).alias(f"baseline_{k}") for k in KPIS])
    target = scenario_targets(both, [scenario], [severity])
    target = storage_rounding(target).withColumnsRenamed({k: f"simulated_{k}" for k in KPIS})
    return compare_kpis(target, [*keys, "scenario", "severity"])


def alert_onsets(df: DataFrame, cell: str = "cell_id", ts: str = "timestamp",
                 chunk: str = "day", tie: Sequence[str] = (),
                 thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Alerts that were not active at the cell's previous observation.

    Steps are compared inside (cell, time chunk) groups, so no group grows with a
    busy cell's history. The first step of a chunk takes its predecessor from the
    last step of the cell's preceding chunk, found on one row per chunk.
    """
    order = [F.col(ts), *[F.col(c) for c in tie]]
    # The texts are made only for what is new.
    rows = df.select(cell, ts, *tie, *alert_kpis(df.columns),
                     active_alerts(df.columns, thresholds).alias("__active"),
                     F.date_trunc(chunk, F.col(ts)).alias("__chunk"))
    last = rows.groupBy(cell, "__chunk").agg(
        F.max(F.struct(*order, F.col("__active"))).alias("__last"))
    per_cell = Window.partitionBy(cell).orderBy("__chunk")
    carried = last.select(
        F.col(cell).alias("__cell"), F.col("__chunk").alias("__at"),
        F.lag("__last.__active").over(per_cell).alias("__carried"))
    within = Window.partitionBy(cell, "__chunk").orderBy(*order)
    rows = rows.withColumn("__before", F.lag("__active").over(within))
    rows = rows.join(carried, rows[cell].eqNullSafe(carried["__cell"])
                     & (rows["__chunk"] == carried["__at"]), "left")
    before = F.coalesce("__before", "__carried", F.lit(0))
    fresh = new_alerts(df.columns, F.col("__active"), before, thresholds)
    return rows.select(cell, ts, *tie, F.inline(fresh)).where(F.col("alert_type").isNotNull())
