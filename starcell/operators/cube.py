"""Cube operators of both marts: summary, roll-up, drill-down, slice, dice, threshold.

Every operator is a choice of grouping, filters and measure block handed to
`Star.aggregate`. Arguments are checked first and wrong ones raise ValueError.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcell.functions import arguments, timeparts
from starcell.functions.labels import TENURE_BANDS
from starcell.plans import measures
from starcell.plans.marts import EXACT_DIGITS, KPIS, customer_block, kpi_means
from starcell.plans.measures import Measure
from starcell.plans.rollups import GRAINS
from starcell.plans.star import Attribute, Condition, Star

# Thresholds a dice accepts, name -> (KPI, comparison).
THRESHOLDS = {
    "call_drop_rate_gt": ("call_drop_rate_pct", ">"),
    "call_drop_rate_pct_gt": ("call_drop_rate_pct", ">"),
    "call_drop_rate_lt": ("call_drop_rate_pct", "<"),
    "call_drop_rate_pct_lt": ("call_drop_rate_pct", "<"),
    "latency_gt": ("latency_ms", ">"),
    "latency_lt": ("latency_ms", "<"),
    "throughput_gt": ("throughput_mbps", ">"),
    "min_active_connections": ("active_connections", ">="),
    # "at least", despite its name
    "active_connections_gt": ("active_connections", ">="),
}
COMPARE = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__}

# Equality filters of a network dice.
DICE_NAMES = ("region", "technology", "cell_id")


def slice_conditions(star: Star, dimension: str, value) -> list[Condition]:
    name = arguments.pick(dimension, star.names(), "dimension")
    return star.conditions(name, value)


@dataclass(frozen=True)
class CustomerCube:
    star: Star
    charge_digits: tuple[int | None, int | None] = (EXACT_DIGITS, EXACT_DIGITS)
    bands: Sequence = field(default=TENURE_BANDS)

    def _block(self, count: str, churned: str, retained: str | None, total: bool = True):
        return customer_block(count, churned, retained, self.charge_digits,
                              total="total_charges" if total else None)

    def summary(self) -> DataFrame:
        return self.star.aggregate(
            self._block("total_customers", "churned_customers", "non_churned_customers"))

    def rollup(self, group_by: str = "tenure_band") -> DataFrame:
        name = arguments.pick(group_by, self.star.names(), "roll-up group")
        block = self._block("customer_count", "churned_customers", "non_churned_customers")
        rows = self.star.aggregate(block, [name])
        if name != "tenure_band":
            return rows.orderBy(name)
        # Bands are disjoint ranges, so their order is that of their smallest tenure.
        labels = F.array(*[F.lit(label) for _, label in self.bands])
        return rows.orderBy(F.array_position(labels, F.col(name)))

    def drilldown(self, tenure_band: str = "0-12 months", into: str = "contract") -> DataFrame:
        name = arguments.pick(into, self.star.names(), "drill-down level")
        where = self.star.conditions("tenure_band", tenure_band)
        block = self._block("customer_count", "churned_customers", None, total=False)
        return self.star.aggregate(block, [name], where).orderBy(
            F.col("customer_count").desc(), name)

    def _subcube(self, where: Sequence[Condition]) -> DataFrame:
        return self.star.aggregate(
            self._block("customer_count", "churned_count", "non_churned_count"), (), where)

    def slice(self, dimension: str, value) -> DataFrame:
        return self._subcube(slice_conditions(self.star, dimension, value))

    def dice(self, filters: Mapping | None = None, **named) -> DataFrame:
        where = []
        for name, value in arguments.given_filters(filters, named).items():
            where += slice_conditions(self.star, name, value)
        return self._subcube(where)


@dataclass(frozen=True)
class NetworkCube:
    star: Star
    digits: Mapping[str, int | None] = field(
        default_factory=lambda: dict.fromkeys(KPIS, EXACT_DIGITS))
    # Foreign keys counted by the summary: output name -> fact column.
    counted: Mapping[str, str] = field(default_factory=lambda: {
        "number_of_cells": "cell_key",
        "number_of_regions": "region_key",
        "number_of_technologies": "technology_key",
    })
    # Attributes that replace `counted` where the fact lacks such a key.
    counted_names: Mapping[str, str] = field(default_factory=dict)

    def _means(self, kpis: Sequence[str] = tuple(KPIS)) -> list[Measure]:
        return kpi_means(self.digits, kpis)

    def summary(self, approximate: float | None = None) -> DataFrame:
        """Totals over the fact alone, members counted on its foreign keys.

        Grouping by the keys first leaves one row per key combination, on which
        the exact distinct counts are cheap; three of them on the fact itself
        would multiply its rows. `approximate` is the allowed error of sketches
        instead (0.001 to 0.5), for facts with too many key combinations to group by.
        """
        block = [measures.row_count("total_observations"), *self._means()]
        names = list(self.counted_names.values())
        columns = {**self.counted, **self.counted_names}
        if approximate is not None:
            error = arguments.number(approximate, "approximate", 0.001, 0.5)
            block += [measures.members(n, c, error) for n, c in columns.items()]
            star, _, first = self.star.answering(block, names)
            done = measures.finish(first(star.rows(names), [], block), [], block)
        else:
            star, _, first = self.star.answering(block, names, keys=list(self.counted.values()))
            parts = first(star.rows(names), list(dict.fromkeys(columns.values())), block)
            merged = parts.agg(
                *[F.count_distinct(c).alias(n) for n, c in columns.items()],
                *[measures.MERGE[p.merge](p.name).alias(p.name) for m in block for p in m.parts])
            done = measures.finish(merged, list(columns), block)
        return done.select("total_observations", *columns,
                           *[m.name for m in block if m.name not in ("total_observations", *columns)])

    def rollup(self, level: str = "minute") -> DataFrame:
        """Time bucket (minute, hour, day, week, month) or any attribute by name."""
        block = [measures.row_count("observation_count"), *self._means()]
        tidy = arguments.pick(level, [*timeparts.LEVEL_FORMATS, "region", "technology", "cell_id"],
                              "roll-up level")
        if tidy not in timeparts.LEVEL_FORMATS:
            return self.star.aggregate(block, [tidy]).orderBy(tidy)
        ts = self.star.attributes["timestamp"]
        star = self.star.with_attribute(
            "time_bucket", Attribute(timeparts.bucket(ts.column, tidy), ts.home,
                                     grain=tidy if tidy in GRAINS else "day"))
        rows = star.aggregate(block, ["time_bucket"]).orderBy("time_bucket")
        return rows.withColumn("time_bucket", timeparts.bucket_text("time_bucket", tidy))

    def drilldown(self, region: str, cell_id: str | None = None) -> DataFrame:
        """Cells of a region, or the time series of one of its cells."""
        where = self.star.conditions("region", region)
        by = ["region", "cell_id", "technology"]
        if cell_id is not None and str(cell_id).strip():
            where += self.star.conditions("cell_id", cell_id)
            rows = self.star.aggregate(self._means(), [*by, "timestamp"], where)
            rows = rows.orderBy("timestamp", "technology")
            return rows.select(*by, timeparts.stamp_text("timestamp").alias("time_grouping"),
                               *[f"avg_{k}" for k in KPIS])
        ts = self.star.attributes["timestamp"]
        star = self.star
        span = []
        if ts.home is None:
            span = [measures.lowest("first_seen", ts.column, of="timestamp"),
                    measures.highest("last_seen", ts.column, of="timestamp")]
            rows = star.aggregate([*span, *self._means()], by, where)
        else:
            rows = self._cells_with_span(where, by)
        period = F.concat_ws(" - ", timeparts.stamp_text("first_seen"),
                             timeparts.stamp_text("last_seen"))
        return rows.orderBy("cell_id", "technology").select(
            *by, period.alias("time_grouping"), *[f"avg_{k}" for k in KPIS])

    def _cells_with_span(self, where: Sequence[Condition], by: Sequence[str]) -> DataFrame:
        """Per-cell means with the first and last time taken from the time dimension."""
        rows = self.star.rows([*by, "timestamp"], where)
        block = [measures.lowest("first_seen", "timestamp"),
                 measures.highest("last_seen", "timestamp"), *self._means()]
        return measures.finish(measures.first_pass(rows, by, block), by, block)

    def _subcube(self, where: Sequence[Condition]) -> DataFrame:
        return self.star.aggregate(
            [measures.row_count("observation_count"), *self._means()], (), where)

    def slice(self, dimension: str, value) -> DataFrame:
        return self._subcube(slice_conditions(self.star, dimension, value))

    def conditions(self, filters: Mapping) -> list[Condition]:
        where = []
        for name, value in filters.items():
            tidy = arguments.pick(
                name, [*DICE_NAMES, *THRESHOLDS, "start_time", "end_time"], "dice filter")
            if tidy in DICE_NAMES:
                where += self.star.conditions(tidy, value)
            elif tidy in THRESHOLDS:
                kpi, sign = THRESHOLDS[tidy]
                if kpi == "active_connections":
                    bound = arguments.whole_number(value, tidy)
                else:
                    bound = arguments.number(value, tidy)
                where.append(Condition(COMPARE[sign](F.col(kpi), bound)))
            else:
                where += self.star.time_conditions(**{tidy.removesuffix("_time"): value})
        return where

    def dice(self, filters: Mapping | None = None, **named) -> DataFrame:
        return self._subcube(self.conditions(arguments.given_filters(filters, named)))

    def high_call_drop(self, threshold: float = 2.0) -> DataFrame:
        """Cells with observations above the threshold; each observation is tested."""
        bound = arguments.number(threshold, "threshold", 0.0, 100.0)
        block = [measures.row_count("observation_count"), *self._means(
            ("call_drop_rate_pct", "latency_ms", "throughput_mbps", "active_connections"))]
        by = ["region", "cell_id", "technology"]
        where = [Condition(F.col("call_drop_rate_pct") > bound)]
        return self.star.aggregate(block, by, where).orderBy(
            F.col("avg_call_drop_rate_pct").desc(), F.col("observation_count").desc(), *by)
