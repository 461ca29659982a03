"""Numbering and running totals in a global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starcell.session import write_and_read

# monotonically_increasing_id holds the part in the bits above these.
PLACE_BITS = 33


def sorted_parts(rows: DataFrame, order: Sequence, values: Sequence[str] = ()) -> DataFrame:
    """Rows with `__place` (from 0 within the part), `__part` and, per part, what came before.

    Rows are range-sorted and stored, so that parts stay the same for every use.
    Only one row per part, its size and totals, is then put in order in one task:
    `__rows_before` and `<value>__before` hold the sums over all earlier parts.
    """
    placed = rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = write_and_read(placed, "sorted").withColumns({
        "__part": F.shiftright("__id", PLACE_BITS),
        "__place": F.col("__id").bitwiseAND(F.lit(2**PLACE_BITS - 1)),
    }).drop("__id")
    totals = placed.groupBy("__part").agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(f"{v}__sum") for v in values])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows_before"),
        *[F.coalesce(F.sum(f"{v}__sum").over(before), F.lit(0)).alias(f"{v}__before") for v in values])
    return placed.join(F.broadcast(starts), "__part")


def number_in_order(rows: DataFrame, order: Sequence, name: str) -> DataFrame:
    """Consecutive numbers from 1."""
    number = F.col("__rows_before") + F.col("__place") + 1
    return sorted_parts(rows, order).select(number.cast("bigint").alias(name), *rows.columns)


def totals_before(rows: DataFrame, order: Sequence, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows ordered before this one."""
    window = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_parts(rows, order, [value])
    within = parts.withColumn(name, F.col(f"{value}__before") + F.coalesce(F.sum(value).over(window), F.lit(0)))
    return within.select(*rows.columns, name)
