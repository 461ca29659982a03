"""Data-quality reports: each is one aggregate over the checked table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcell.plans.marts import GENDERS, PLAN_COLUMNS, REGIONS, TECHNOLOGIES, YES_NO


@dataclass(frozen=True)
class Rule:
    """A named test. Like SQL CHECK it passes on NULL; `required` forbids NULL."""

    name: str
    test: Column

    def broken(self) -> Column:
        return ~F.coalesce(self.test, F.lit(True))


def required(column: str) -> Rule:
    return Rule(f"{column} not null", F.col(column).isNotNull())


def one_of(column: str, values: Sequence) -> Rule:
    return Rule(f"{column} in domain", F.col(column).isin(*values))


def at_least(column: str, low: float) -> Rule:
    return Rule(f"{column} >= {low}", F.col(column) >= low)


def within(column: str, low: float, high: float) -> Rule:
    return Rule(f"{column} in [{low}, {high}]", F.col(column).between(low, high))


CUSTOMER_DOMAINS = {"gender": GENDERS, "Partner": YES_NO, "Dependents": YES_NO,
                    **{c: domain for c, (_, domain) in PLAN_COLUMNS.items()}}
NETWORK_DOMAINS = {"region": REGIONS, "technology": TECHNOLOGIES}


def customer_rules() -> list[Rule]:
    """Checks of a staged customer row."""
    needed = ["customerID", *CUSTOMER_DOMAINS, "SeniorCitizen", "tenure", "monthly_charges",
              "churn_flag"]
    return [
        *[required(c) for c in needed],
        *[one_of(c, values) for c, values in CUSTOMER_DOMAINS.items()],
        one_of("SeniorCitizen", (0, 1)),
        one_of("churn_flag", (0, 1)),
        at_least("tenure", 0),
        at_least("monthly_charges", 0),
        at_least("total_charges", 0),
    ]


def network_rules() -> list[Rule]:
    """Checks of a staged telemetry row."""
    percents = ("packet_loss_pct", "call_drop_rate_pct", "handover_success_pct")
    floors = ("latency_ms", "throughput_mbps", "active_connections")
    needed = ["cell_id", "region", "technology", "timestamp", *floors, *percents,
              "signal_strength_dbm"]
    parts = {"hour": (0, 23), "minute": (0, 59), "day": (1, 31), "month": (1, 12), "quarter": (1, 4)}
    return [
        *[required(c) for c in needed],
        *[one_of(c, values) for c, values in NETWORK_DOMAINS.items()],
        *[at_least(c, 0) for c in floors],
        *[within(c, 0, 100) for c in percents],
        *[within(c, low, high) for c, (low, high) in parts.items()],
        at_least("year", 2000),
    ]


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")


def _long(df: DataFrame, label: str, counts: Mapping[str, Column], value: str) -> DataFrame:
    """Several counts of one pass as rows (label, value)."""
    one_row = df.agg(*[count.alias(f"c{i}") for i, count in enumerate(counts.values())])
    entries = [F.struct(F.lit(name).alias(label), F.col(f"c{i}").alias(value))
               for i, name in enumerate(counts)]
    return one_row.select(F.inline(F.array(*entries)))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    return _long(df, "column_name", {c: F.count_if(F.col(c).isNull()) for c in columns}, "null_count")


def surplus_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, in one row."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their count."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return groups.where("row_count > 1").orderBy(*keys)


def domain_violations(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values outside their column's domain, with the rows that hold them."""
    found = [F.when(~F.col(c).isin(*values), F.struct(
        F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")))
        for c, values in domains.items()]
    rows = df.select(F.inline(F.array_compact(F.array(*found))))
    return rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("row_count"))


def rule_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violations per rule, zero included."""
    return _long(df, "rule", {r.name: F.count_if(r.broken()) for r in rules}, "violation_count")


def split_by_rules(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    marked = df.withColumn("broken_rules", broken)
    accepted = marked.where(F.size("broken_rules") == 0).drop("broken_rules")
    return accepted, marked.where(F.size("broken_rules") > 0)


def orphan_report(fact: DataFrame, references: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Fact rows whose foreign key has no dimension row, one line per key.

    Keys are counted before the anti join, so a hot key is one row.
    """
    lines = None
    for fact_key, (dimension, key) in references.items():
        held = fact.groupBy(F.col(fact_key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        lost = held.join(dimension.select(F.col(key).alias("k")), "k", "left_anti")
        line = lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphan_rows"),
                        F.count(F.lit(1)).alias("orphan_keys"))
        line = line.select(F.lit(fact_key).alias("foreign_key"), "orphan_rows", "orphan_keys")
        lines = line if lines is None else lines.unionByName(line)
    return lines


def require_zero(report: DataFrame, count: str, what: str) -> None:
    """Raise when a report holds a count above zero; only offending lines are read, 20 at most."""
    offending = report.where(F.col(count) > 0).take(20)
    if offending:
        raise ValueError(f"{what}: {[r.asDict() for r in offending]}")
