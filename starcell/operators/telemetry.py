"""Look-ups on the telemetry mart: inventory, detail, time series, baselines."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcell.functions import arguments
from starcell.functions.numeric import as_column, round_half_up
from starcell.functions.timeparts import stamp_text
from starcell.plans import measures
from starcell.plans.marts import KPIS
from starcell.plans.star import Condition, Star

PLACE = ("cell_id", "region", "technology")


def storage_rounding(df: DataFrame) -> DataFrame:
    """KPIs with the decimals they are stored and shown with."""
    return df.withColumns({
        kpi: F.col(kpi).cast("int") if kpi == "active_connections" else round_half_up(kpi, places)
        for kpi, (places, _) in KPIS.items() if kpi in df.columns})


def require_cell(star: Star, cell_id: str | None) -> None:
    """Raise for a cell that the star does not know; at most one row is read back."""
    if cell_id is None:
        return
    home = star.attributes["cell_id"].home
    known = star.fact if home is None else star.dimensions[home].frame
    require_key(known, star.attributes["cell_id"].column, cell_id)


def _same_text(star: Star, name: str, value: str) -> Condition:
    attribute = star.attributes[name]
    return Condition(F.lower(attribute.column) == arguments.text(value).lower(), attribute.home)


def list_cells(star: Star, region: str | None = None, technology: str | None = None,
               match_case: bool = False) -> DataFrame:
    """Distinct (cell, region, technology) seen in the fact, sorted by cell."""
    given = arguments.given_filters({"region": region, "technology": technology}, {})
    if match_case:
        where = [Condition(star.attributes[n].column == v, star.attributes[n].home)
                 for n, v in given.items()]
    else:
        where = [_same_text(star, n, v) for n, v in given.items()]
    return star.aggregate([measures.row_count("n")], PLACE, where).select(*PLACE).orderBy(*PLACE)


def filter_options(star: Star) -> DataFrame:
    """The distinct values a user may filter the inventory by."""
    cells = list_cells(star)
    return (cells.select(F.explode(F.array(
        F.struct(F.lit("region").alias("option"), F.col("region").alias("value")),
        F.struct(F.lit("technology").alias("option"), F.col("technology").alias("value")),
    )).alias("o")).select("o.*").where("value IS NOT NULL").distinct().orderBy("option", "value"))


def cell_detail(star: Star, cell_id: str | None = None) -> DataFrame:
    """Observation count with first and last time, of one cell or of all."""
    require_cell(star, cell_id)
    where = [] if cell_id is None else star.conditions("cell_id", cell_id)
    ts = star.attributes["timestamp"]
    block = [measures.row_count("available_observation_count")]
    if ts.home is None:
        block += [measures.lowest("start_time", ts.column, of="timestamp"),
                  measures.highest("end_time", ts.column, of="timestamp")]
        rows = star.aggregate(block, PLACE, where)
    else:
        block += [measures.lowest("start_time", "timestamp"), measures.highest("end_time", "timestamp")]
        wide = star.rows([*PLACE, "timestamp"], where)
        rows = measures.finish(measures.first_pass(wide, PLACE, block), PLACE, block)
    return rows.withColumns({c: stamp_text(c) for c in ("start_time", "end_time")}).orderBy(*PLACE)


def cell_telemetry(star: Star, cell_id: str, start_time: str | None = None,
                   end_time: str | None = None, limit: int | None = None) -> DataFrame:
    """A cell's observations in an inclusive time range, in order; `limit` keeps the first ones."""
    limit = None if limit is None else arguments.whole_number(limit, "limit", 1)
    require_cell(star, cell_id)
    where = [*star.conditions("cell_id", cell_id), *star.time_conditions(start_time, end_time)]
    rows = star.rows([*PLACE, "timestamp"], where)
    # All columns in the order make the cut the same on every run.
    rows = rows.orderBy("timestamp", "technology", *KPIS)
    rows = rows if limit is None else rows.limit(limit)
    return storage_rounding(rows.select(
        stamp_text("timestamp").alias("timestamp"), "region", "cell_id", "technology", *KPIS))


def _summary_block(digits: Mapping[str, int | None]) -> list[measures.Measure]:
    block = [measures.row_count("observation_count")]
    for kpi, (places, mean_places) in KPIS.items():
        block += [
            measures.mean(f"avg_{kpi}", kpi, digits[kpi], mean_places, empty=None),
            measures.lowest(f"min_{kpi}", F.col(kpi).cast("double"), places, of=kpi),
            measures.highest(f"max_{kpi}", F.col(kpi).cast("double"), places, of=kpi),
        ]
    return block


def cell_summary(star: Star, digits: Mapping[str, int | None], cell_id: str | None = None) -> DataFrame:
    """Minimum, maximum and average of every KPI, one wide row per cell."""
    require_cell(star, cell_id)
    where = [] if cell_id is None else star.conditions("cell_id", cell_id)
    return star.aggregate(_summary_block(digits), PLACE, where)


def cell_summary_long(star: Star, digits: Mapping[str, int | None],
                      cell_id: str | None = None) -> DataFrame:
    """The same as one row per cell and KPI."""
    wide = cell_summary(star, digits, cell_id)
    entries = F.array(*[
        F.struct(F.lit(k).alias("metric_key"),
                 *[F.col(f"{stat}_{k}").alias(stat) for stat in ("min", "max", "avg")])
        for k in KPIS])
    return wide.select(*PLACE, "observation_count", F.inline(entries))


def missing_keys(requested: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Requested keys that the dimension lacks; empty when all exist."""
    wanted = requested.select(key).distinct()
    return wanted.join(dimension.select(key), key, "left_anti")


def known_keys(requested: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    wanted = requested.select(key).distinct()
    return wanted.join(dimension.select(key), key, "left_semi")


def require_key(dimension: DataFrame, key: str | Column, value: str) -> None:
    """Raise when a single key does not exist; at most one row is read back."""
    if dimension.where(as_column(key) == value).limit(1).isEmpty():
        raise ValueError(f"key {value!r} does not exist")


def first_baselines(star: Star, cell_id: str | None = None) -> DataFrame:
    """Earliest observation of every cell.

    The minimum of (time, values) is one map-side combined aggregate, so a busy
    cell costs one row per task; on equal times the smallest values win.
    """
    require_cell(star, cell_id)
    where = [] if cell_id is None else star.conditions("cell_id", cell_id)
    ts = star.attributes["timestamp"]
    if ts.home is None:
        fields = F.struct(ts.column.alias("timestamp"), *[F.col(k) for k in KPIS])
        rows = star.aggregate([measures.lowest("first", fields)], PLACE, where)
    else:
        wide = star.rows([*PLACE, "timestamp"], where)
        rows = wide.groupBy(*PLACE).agg(F.min(F.struct("timestamp", *KPIS)).alias("first"))
    # A cell seen in several places keeps the earliest of them.
    whole = F.struct("first.timestamp", "region", "technology", *[f"first.{k}" for k in KPIS])
    rows = rows.groupBy("cell_id").agg(F.min(whole).alias("first")).select("cell_id", "first.*")
    return storage_rounding(rows.withColumn("timestamp", stamp_text("timestamp")))


def baselines_at(star: Star, requests: DataFrame) -> DataFrame:
    """Observations at requested (cell_id, timestamp) pairs, timestamps as text.

    Requests are turned into the fact's keys first, and the fact is cut down to them (and
    to their days, where it is partitioned by day) before any name is joined to it.
    """
    wanted = requests.select(
        F.col("cell_id").alias("__cell_id"),
        F.col("timestamp").cast("timestamp_ntz").alias("__timestamp")).distinct()
    if star.day_column:
        wanted = wanted.withColumn("__day", F.col("__timestamp").cast("date"))
    fact, match = star.fact, []
    for name in ("cell_id", "timestamp"):
        attribute = star.attributes[name]
        if attribute.home is None:
            match.append(attribute.column == F.col(f"__{name}"))
            continue
        dimension = star.dimensions[attribute.home]
        side = dimension.frame.select(F.col(dimension.key).alias(f"__key_{name}"),
                                      attribute.column.alias(f"__of_{name}"))
        wanted = wanted.join(side, F.col(f"__{name}") == F.col(f"__of_{name}")).drop(f"__of_{name}")
        match.append(fact[dimension.fact_key] == F.col(f"__key_{name}"))
    if star.day_column:
        match.append(fact[star.day_column] == F.col("__day"))
    rows = replace(star, fact=fact.join(wanted, match, "left_semi")).rows([*PLACE, "timestamp"])
    rows = rows.select(*PLACE, stamp_text("timestamp").alias("timestamp"), *KPIS)
    return storage_rounding(rows)
