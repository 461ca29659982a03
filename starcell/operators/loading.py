"""Staging, dimension build, key resolution, fact load and reconciliation."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcell.functions.labels import band_label
from starcell.functions.timeparts import calendar_parts
from starcell.operators import quality
from starcell.plans import measures
from starcell.plans.marts import KPIS, PLAN_COLUMNS, customer_block, kpi_means
from starcell.plans.measures import Measure
from starcell.plans.ordering import number_in_order
from starcell.plans.rollups import CUSTOMER_SHAPES, NETWORK_SHAPES, Shape
from starcell.plans.sizing import broadcast_if_small, fits_broadcast
from starcell.plans.star import Star
from starcell.session import fresh_path, write_and_read
from starcell.sources.warehouse import Warehouse

WHITESPACE = " \t\n\r\x0b\x0c"
TIME_COLUMNS = ("timestamp", "date", "hour", "minute", "day", "month", "quarter", "year")


def trim_text(df: DataFrame) -> DataFrame:
    """Strip every kind of blank from all text columns."""
    text = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: F.btrim(F.col(c), F.lit(WHITESPACE)) for c in text})


def blank_audit(raw: DataFrame) -> DataFrame:
    """Blank total charges, and those of accounts that are not new."""
    blank = F.btrim("TotalCharges", F.lit(WHITESPACE)) == ""
    old = F.btrim("tenure", F.lit(WHITESPACE)) != "0"
    return raw.agg(F.count_if(blank).alias("blank_total_charges"),
                   F.count_if(blank & old).alias("blank_with_tenure"))


def yes_no_flag(value: Column) -> Column:
    """1, 0, or NULL for any other text."""
    return F.when(value == "Yes", 1).when(value == "No", 0)


def stage_customer(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Trimmed, typed customer rows. Unparsable numbers fail, or become NULL when not strict."""
    convert = Column.cast if strict else Column.try_cast
    rows = trim_text(raw)
    total = F.when(F.col("TotalCharges") == "", F.lit(0.0)).otherwise(
        convert(F.nullif("TotalCharges", F.lit("")), "double"))
    flag = yes_no_flag(F.col("Churn"))
    if strict:
        wrong = F.concat(F.lit("Churn is neither Yes nor No: "), F.coalesce("Churn", F.lit("NULL")))
        flag = F.when(flag.isNull(), F.raise_error(wrong)).otherwise(flag)
    rows = rows.withColumns({
        "tenure": convert(F.col("tenure"), "int"),
        "SeniorCitizen": convert(F.col("SeniorCitizen"), "int"),
        "monthly_charges": convert(F.col("MonthlyCharges"), "double"),
        "total_charges": total,
        "churn_flag": flag,
    }).drop("MonthlyCharges", "TotalCharges", "Churn")
    return rows.withColumn("tenure_band", band_label("tenure"))


def stage_network(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Trimmed telemetry with parsed time and calendar parts; NaN counts as missing."""
    convert = Column.cast if strict else Column.try_cast
    rows = trim_text(raw)
    rows = rows.withColumn("timestamp", convert(F.col("timestamp"), "timestamp_ntz"))
    missing = F.lit(None).cast("double")
    rows = rows.withColumns({
        k: convert(F.col(k), "int") if k == "active_connections"
        else F.nanvl(convert(F.col(k), "double"), missing) for k in KPIS})
    return rows.withColumns(calendar_parts("timestamp"))


def build_dimension(staged: DataFrame, columns: Sequence[str | Column], natural: Sequence[str],
                    key: str) -> DataFrame:
    """Distinct members with a surrogate key in natural-key order."""
    # Stored, so that counting and numbering do not each scan the staged rows.
    members = write_and_read(staged.select(*columns).distinct(), "members")
    return number_in_order(members, natural, key)


def resolve_keys(staged: DataFrame, dimensions: Mapping[str, tuple[DataFrame, Mapping[str, str]]],
                 ) -> DataFrame:
    """Adds each dimension's key, found by natural key; NULL where there is none.

    `dimensions`: key name -> (dimension, {staged column: dimension column}).
    Small dimensions are joined first, so that a natural key no one reads later is not shuffled for the others.
    """
    rows = staged
    sides = {key: dimension.select(F.col(key), *[F.col(theirs).alias(f"__{ours}") for ours, theirs in pairs.items()])
             for key, (dimension, pairs) in dimensions.items()}
    small = {key: fits_broadcast(side) for key, side in sides.items()}
    for key in sorted(sides, key=lambda key: not small[key]):
        pairs = dimensions[key][1]
        match = [F.col(ours) == F.col(f"__{ours}") for ours in pairs]
        side = F.broadcast(sides[key]) if small[key] else sides[key]
        rows = rows.join(side, match, "left").drop(*[f"__{o}" for o in pairs])
    return rows.select(*staged.columns, *dimensions)


def require_keys(keys: Sequence[str]) -> list[Column]:
    """The key columns, which fail the job that writes them when one was not found."""
    return [F.when(F.col(k).isNull(), F.raise_error(F.lit(f"unresolved {k}"))).otherwise(F.col(k)).alias(k)
            for k in keys]


def unresolved_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return quality.null_counts(rows, keys)


def extend_dimension(house: Warehouse, members: DataFrame, natural: Sequence[str], key: str,
                     name: str, reset: bool) -> DataFrame:
    """Write a dimension, or on append only its new members, numbered after the old ones."""
    members = write_and_read(members, "members")
    if reset or not house.exists(name):
        return house.write(number_in_order(members, natural, key), name)
    held = house.read(name)
    last = held.agg(F.coalesce(F.max(key), F.lit(0)).alias("n")).first()["n"]
    fresh = number_in_order(members.join(held.select(*natural), list(natural), "left_anti"),
                            natural, key)
    return house.write(fresh.withColumn(key, F.col(key) + last), name, reset=False)


def _next_id(house: Warehouse, surrogate: str, name: str, reset: bool) -> int:
    if reset or not house.exists(name):
        return 1
    last = house.read(name).agg(F.max(surrogate).alias("n")).first()["n"]
    return 1 if last is None else last + 1


def _empty_rollups(house: Warehouse, shapes: Mapping[str, Shape]) -> None:
    """Before a fact is replaced, so that a load that breaks off leaves no rollup of the old one."""
    for name in shapes:
        if house.exists(name):
            house.write(house.spark.createDataFrame([], house.read(name).schema), name)


def _keep_rollups(house: Warehouse, star: Star, shapes: Mapping[str, Shape], block: Sequence[Measure],
                  surrogate: str, start: int) -> None:
    """Add the fact rows from `start` on to each rollup; one that lacks earlier rows is made anew."""
    before = star.fact.where(F.col(surrogate) < start).count() if start > 1 else 0
    for name, shape in shapes.items():
        parts = [*block, *[measures.members(c, c) for c in shape.sketched]]
        held = house.read(name).agg(F.sum(measures.ROW_COUNT).alias("n")).first()["n"] if house.exists(name) else None
        whole = start == 1 or held != before
        rows = star.fact if whole else star.fact.where(F.col(surrogate) >= start)
        house.write(shape.build(replace(star, fact=rows), parts), name, whole)


def _store_fact(house: Warehouse, resolved: DataFrame, keys: Sequence[str], columns: Sequence,
                surrogate: str, name: str, reset: bool, partition_by: str | None) -> DataFrame:
    """Write the fact with unique row ids; a key that was not found fails the write."""
    start = _next_id(house, surrogate, name, reset)
    rows = resolved.select(*require_keys(keys), *columns)
    if partition_by:
        # One day per file where days are small; a day too large for one task is split.
        rows = rows.hint("rebalance", partition_by)
    number = (F.monotonically_increasing_id() + start).alias(surrogate)
    return house.write(rows.select(number, "*"), name, reset, partition_by)


@dataclass
class Staged:
    """Accepted and rejected rows as stored, and what was counted of them."""

    rows: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def _one_per_key(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row of each key (the least one), and those beyond it, equal ones as one row with `copies`."""
    columns = rows.columns
    groups = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    first = groups.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("one"), F.sum("copies").alias("n"))
    first = write_and_read(first, "keyed")
    kept = first.select("one.*")
    # Only keys with several rows are looked at again.
    several = first.where("n > 1").select(*[F.col(k).alias(f"__{k}") for k in keys], "one")
    again = groups.join(several, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    is_first = F.struct(*columns).eqNullSafe(F.col("one"))
    beyond = again.withColumn("copies", F.col("copies") - is_first.cast("bigint")).where("copies > 0")
    return kept, beyond.select(*columns, "copies")


def _store_staged(staged: DataFrame, rules: Sequence[quality.Rule], keys: Sequence[str], name: str,
                  quarantine: bool, counted: Mapping[str, Column] | None = None) -> Staged:
    """Staged rows on disk, split by the rules; the source is read once.

    Rows that break a rule, and those beyond the first of a natural key, fail the load or, with
    `quarantine`, are set apart with the names of the rules they break.
    """
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    marked = staged.withColumn("broken_rules", broken).withColumn("accepted", F.size("broken_rules") == 0)
    metrics = {"source_rows": F.count(F.lit(1)), **(counted or {}),
               **{f"broken{i}": F.count_if(F.array_contains("broken_rules", r.name)) for i, r in enumerate(rules)}}
    path = fresh_path(staged.sparkSession, name)
    # A partitioned write would sort all rows by what nearly all of them share.
    marked.write.parquet(path)
    stored = staged.sparkSession.read.schema(marked.schema).parquet(path)
    # Counted on what is stored. An Observation would do so during the write, but a session that
    # has held one can no longer ship models that keep their training summary.
    found = stored.agg(*[m.alias(n) for n, m in metrics.items()]).first().asDict()
    names = [c for c in marked.columns if c not in ("broken_rules", "accepted") and not c.startswith("__")]
    rows = stored.where("accepted").select(*names)
    copies = F.lit(1).cast("bigint").alias("copies")
    rejected = stored.where("not accepted").select(*names, "broken_rules", copies)
    if not quarantine:
        offending = [{"rule": r.name, "violation_count": found[f"broken{i}"]}
                     for i, r in enumerate(rules) if found[f"broken{i}"]]
        if offending:
            raise ValueError(f"rules broken: {offending[:20]}")
    surplus = quality.surplus_duplicates(rows, keys).first()["duplicate_count"]
    if surplus and not quarantine:
        raise ValueError(f"duplicate {list(keys)}: {surplus} rows")
    if surplus:
        rows, beyond = _one_per_key(rows, keys)
        rejected = rejected.unionByName(beyond.withColumn("broken_rules", F.array(F.lit(f"{', '.join(keys)} unique"))))
        rows = write_and_read(rows, name)
    return Staged(rows, rejected, found)


def _unknown_only(staged: DataFrame, known: DataFrame, keys: Sequence[str], on_known: str) -> DataFrame:
    """Rows whose keys the fact does not hold; known ones fail the load or are left out."""
    if on_known == "fail":
        if staged.join(known, list(keys), "left_semi").take(1):
            raise ValueError(f"some {' and '.join(keys)} values are already loaded")
        return staged
    return write_and_read(staged.join(known, list(keys), "left_anti"), "unknown")


def _append_options(on_known: str) -> None:
    if on_known not in ("fail", "skip"):
        raise ValueError("on_known must be 'fail' or 'skip'")


def load_customer(house: Warehouse, raw: DataFrame, reset: bool = True, quarantine: bool = False,
                  on_known: str = "fail", rollup_digits: Sequence[int | None] | None = None) -> DataFrame:
    """Load the customer mart from text rows; returns the audit record.

    Rows that break a rule fail the load; with `quarantine` they are kept in the table
    `rejected_customer` and the others are loaded. On append, accounts that the fact already
    holds fail the load or are skipped (`on_known`). Only the fact is asked, so an append that
    broke off before its fact was written can be repeated: members it left are found again.

    `rollup_digits` (decimals of monthly and total charges, None for sums of doubles) keeps partial
    aggregates in `plans.rollups.CUSTOMER_SHAPES`; a cube that declares the same ones is answered from them.
    """
    _append_options(on_known)
    if reset:
        _empty_rollups(house, CUSTOMER_SHAPES)
    start = _next_id(house, "customer_churn_key", "fact_customer_churn", reset)
    plan = list(PLAN_COLUMNS)
    blank = F.btrim("TotalCharges", F.lit(WHITESPACE)) == ""
    old = F.btrim("tenure", F.lit(WHITESPACE)) != "0"
    checked = raw.withColumns({"__blank": blank, "__old": blank & old})
    rules = quality.customer_rules() + ([quality.required("total_charges")] if quarantine else [])
    staged = _store_staged(stage_customer(checked, strict=not quarantine), rules, ["customerID"], "staged_customer",
                           quarantine, {"blank_total_charges_cleaned": F.count_if("__blank"), "__old": F.count_if("__old")})
    if staged.counts["__old"]:
        warnings.warn(f"{staged.counts['__old']} accounts with a tenure have blank total charges", stacklevel=2)
    rows = staged.rows
    if not reset and house.exists("fact_customer_churn"):
        known = house.read("fact_customer_churn").select("customer_key").join(house.read("dim_customer"), "customer_key")
        rows = _unknown_only(rows, known.select("customerID"), ["customerID"], on_known)
    who = rows.select("customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure")
    customers = extend_dimension(house, who, ["customerID"], "customer_key", "dim_customer", reset)
    plans = extend_dimension(house, rows.select(*plan).distinct(), plan, "plan_key", "dim_plan", reset)
    resolved = resolve_keys(rows, {
        "customer_key": (customers, {"customerID": "customerID"}),
        "plan_key": (plans, {c: c for c in plan}),
    })
    fact = _store_fact(house, resolved, ["customer_key", "plan_key"],
                       ["monthly_charges", "total_charges", "churn_flag",
                        F.lit(1).alias("customer_count")],
                       "customer_churn_key", "fact_customer_churn", reset, None)
    if rollup_digits is not None:
        _keep_rollups(house, house.customer_star(rollups=False), CUSTOMER_SHAPES,
                      customer_block("n", "churned", "retained", tuple(rollup_digits)), "customer_churn_key", start)
    if quarantine:
        house.write(staged.rejected, "rejected_customer", reset)
    return audit(staged, {"dim_customer_rows": customers, "dim_plan_rows": plans, "fact_customer_churn_rows": fact},
                 ["blank_total_charges_cleaned"])


def load_network(house: Warehouse, raw: DataFrame, reset: bool = True, quarantine: bool = False,
                 on_known: str = "fail", rollup_digits: Mapping[str, int | None] | None = None) -> DataFrame:
    """Load the network mart; the fact holds its time and is partitioned by day. Returns the audit record.

    `quarantine` (into `rejected_network`), `on_known` and repeated appends work as in
    `load_customer`, the natural key being the cell and the timestamp. Of the fact, only days
    that the new rows fall on are asked. `rollup_digits` (decimals of each KPI) keeps the hourly and
    daily partial aggregates of `plans.rollups.NETWORK_SHAPES`.
    """
    _append_options(on_known)
    if reset:
        _empty_rollups(house, NETWORK_SHAPES)
    start = _next_id(house, "network_kpi_key", "fact_network_kpi", reset)
    staged = _store_staged(stage_network(raw, strict=not quarantine), quality.network_rules(), ["cell_id", "timestamp"],
                           "staged_network", quarantine)
    rows = staged.rows
    if not reset and house.exists("fact_network_kpi"):
        # Partition pruning at run time: the days come from the new rows.
        days = broadcast_if_small(rows.select(F.col("date").alias("fact_date")).distinct())
        held = house.read("fact_network_kpi").select("cell_key", "timestamp", "fact_date").join(days, "fact_date", "left_semi")
        known = held.join(house.read("dim_cell"), "cell_key")
        rows = _unknown_only(rows, known.select("cell_id", "timestamp"), ["cell_id", "timestamp"], on_known)
    members = {
        "dim_cell": ("cell_key", ["cell_id"], [F.col("cell_id")]),
        "dim_region": ("region_key", ["region_name"], [F.col("region").alias("region_name")]),
        "dim_network_tech": ("technology_key", ["technology_name"],
                             [F.col("technology").alias("technology_name")]),
        "dim_time": ("time_key", ["timestamp"], [F.col(c) for c in TIME_COLUMNS]),
    }
    dims = {name: extend_dimension(house, rows.select(*columns).distinct(), natural, key, name, reset)
            for name, (key, natural, columns) in members.items()}
    keys = {
        "cell_key": (dims["dim_cell"], {"cell_id": "cell_id"}),
        "region_key": (dims["dim_region"], {"region": "region_name"}),
        "technology_key": (dims["dim_network_tech"], {"technology": "technology_name"}),
        "time_key": (dims["dim_time"], {"timestamp": "timestamp"}),
    }
    fact = _store_fact(house, resolve_keys(rows, keys), list(keys),
                       [*KPIS, F.lit(1).alias("reading_count"), "timestamp", F.col("date").alias("fact_date")],
                       "network_kpi_key", "fact_network_kpi", reset, "fact_date")
    if rollup_digits is not None:
        seen = F.col("timestamp")
        block = [measures.row_count("n"), *kpi_means(rollup_digits),
                 measures.lowest("first", seen, of="timestamp"), measures.highest("last", seen, of="timestamp")]
        for kpi in KPIS:
            value = F.col(kpi).cast("double")
            block += [measures.lowest(f"min_{kpi}", value, of=kpi), measures.highest(f"max_{kpi}", value, of=kpi)]
        _keep_rollups(house, house.network_star(rollups=False), NETWORK_SHAPES, block, "network_kpi_key", start)
    if quarantine:
        house.write(staged.rejected, "rejected_network", reset)
    return audit(staged, {"dim_cell_rows": dims["dim_cell"], "dim_region_rows": dims["dim_region"],
                          "dim_tech_rows": dims["dim_network_tech"], "dim_time_rows": dims["dim_time"],
                          "fact_network_kpi_rows": fact})


def audit(staged: Staged, tables: Mapping[str, DataFrame], noted: Sequence[str] = ()) -> DataFrame:
    """One row of counts: those of the staged source, and the rows of stored tables."""
    parts = {"staging_rows": staged.rows, **tables}
    long = None
    for name, df in parts.items():
        line = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        long = line if long is None else long.unionByName(line)
    row = long.agg(*[F.max(F.when(F.col("part") == n, F.col("n"))).alias(n) for n in parts])
    known = {n: F.lit(staged.counts[n]).cast("bigint") for n in ("source_rows", *noted)}
    return row.withColumns({
        **known, "accepted_rows": F.col("staging_rows"),
        "rejected_rows": known["source_rows"] - F.col("staging_rows"),
    })


def reconcile_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts side by side, and whether they are all equal."""
    long = None
    for name, df in tables.items():
        line = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        long = line if long is None else long.unionByName(line)
    row = long.agg(*[F.max(F.when(F.col("part") == n, F.col("n"))).alias(f"{n}_rows") for n in tables],
                   (F.min("n") == F.max("n")).alias("all_equal"))
    return row


def reconcile_totals(source: DataFrame, warehouse: DataFrame,
                     metrics: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Each metric computed on both sides: (metric, source, warehouse, difference)."""
    def side(df: DataFrame, place: int, name: str) -> DataFrame:
        row = df.agg(*[pair[place].cast("double").alias(f"m{i}") for i, pair in enumerate(metrics.values())])
        entries = [F.struct(F.lit(metric).alias("metric"), F.col(f"m{i}").alias(name))
                   for i, metric in enumerate(metrics)]
        return row.select(F.inline(F.array(*entries)))

    both = side(source, 0, "source_value").join(side(warehouse, 1, "warehouse_value"), "metric")
    return both.withColumn("difference", F.abs(F.col("source_value") - F.col("warehouse_value")))


def lenient_number(text: Column) -> Column:
    """Number in a text, NULL when there is none."""
    return F.btrim(text, F.lit(WHITESPACE)).try_cast("double")


