"""Measures as partial aggregates that can be merged again.

A fact is aggregated before it meets a large dimension, so every measure is kept
as parts (sums, counts, extremes, sketches) with a rule to merge them and a final column.
A part that has a `stored` name says what it holds, whatever the measure is called, so
that a table of partial aggregates can hold it (`plans.rollups`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcell.functions.numeric import (
    as_column,
    exact_mean,
    exact_sum,
    from_units,
    join_parts,
    round_half_up,
    sum_parts,
)

MERGE: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "sketch": F.hll_union_agg}

ROW_COUNT = "row_count"
# Registers of a stored sketch, as a power of two: a relative error of 1.04 / 64.
SKETCH_BITS = 12


@dataclass(frozen=True)
class Part:
    name: str
    first: Column
    merge: str
    stored: str | None = None


@dataclass(frozen=True)
class Measure:
    name: str
    parts: tuple[Part, ...]
    result: Column


def row_count(name: str) -> Measure:
    part = Part(f"{name}__n", F.count(F.lit(1)), "sum", ROW_COUNT)
    return Measure(name, (part,), F.coalesce(F.col(part.name), F.lit(0)).cast("bigint"))


def count_where(name: str, test: Column, stored: str | None = None) -> Measure:
    part = Part(f"{name}__n", F.count_if(test), "sum", stored)
    return Measure(name, (part,), F.coalesce(F.col(part.name), F.lit(0)).cast("bigint"))


def _stored(value, kind: str) -> str | None:
    return f"{value}__{kind}" if isinstance(value, str) else None


def members(name: str, column: str, error: float | None = None) -> Measure:
    """How many different values (whole numbers or texts), by sketches that merge.

    `error` is the relative error of one standard deviation.
    """
    bits = SKETCH_BITS if error is None else max(SKETCH_BITS, math.ceil(2 * math.log2(1.04 / error)))
    part = Part(f"{name}__k", F.hll_sketch_agg(column, bits), "sketch", _stored(column, f"sketch{bits}"))
    return Measure(name, (part,), F.coalesce(F.hll_sketch_estimate(part.name), F.lit(0)).cast("bigint"))


def _sum_of(name: str, value, digits: int | None) -> tuple[tuple[Part, ...], Column]:
    """Parts of a sum, and the total they make."""
    if digits is None:
        part = Part(f"{name}__s", exact_sum(value, None), "sum", _stored(value, "sum"))
        return (part,), F.col(part.name)
    high, low = sum_parts(value, digits)
    parts = (Part(f"{name}__h", high, "sum", _stored(value, f"sum{digits}_high")),
             Part(f"{name}__l", low, "sum", _stored(value, f"sum{digits}_low")))
    return parts, join_parts(*[p.name for p in parts])


def mean(name: str, value, digits: int | None, places: int = 2, factor: float | None = None,
         empty: float | None = 0.0) -> Measure:
    """Rounded mean over the non-NULL values; `empty` stands in when there are none."""
    parts, whole = _sum_of(name, value, digits)
    count = Part(f"{name}__c", F.count(as_column(value)), "sum", _stored(value, "count"))
    result = exact_mean(whole, count.name, digits)
    if factor is not None:
        result = result * factor
    if empty is not None:
        result = F.coalesce(result, F.lit(empty))
    return Measure(name, (*parts, count), round_half_up(result, places))


def total(name: str, value, digits: int | None) -> Measure:
    parts, whole = _sum_of(name, value, digits)
    return Measure(name, parts, F.coalesce(from_units(whole, digits), F.lit(0.0)))


def lowest(name: str, value, places: int | None = None, of: str | None = None) -> Measure:
    """The least value; `of` names what an expression stands for, so that it can be stored."""
    part = Part(f"{name}__x", F.min(as_column(value)), "min", _stored(of or value, "min"))
    result = F.col(part.name)
    return Measure(name, (part,), result if places is None else round_half_up(result, places))


def highest(name: str, value, places: int | None = None, of: str | None = None) -> Measure:
    part = Part(f"{name}__x", F.max(as_column(value)), "max", _stored(of or value, "max"))
    result = F.col(part.name)
    return Measure(name, (part,), result if places is None else round_half_up(result, places))


def first_pass(rows: DataFrame, by: Sequence, block: Sequence[Measure]) -> DataFrame:
    """Partial aggregates of a block per key; Spark combines them map-side."""
    return rows.groupBy(*by).agg(*[p.first.alias(p.name) for m in block for p in m.parts])


def second_pass(parts: DataFrame, by: Sequence, block: Sequence[Measure]) -> DataFrame:
    """Merge partial aggregates onto coarser keys."""
    return parts.groupBy(*by).agg(
        *[MERGE[p.merge](p.name).alias(p.name) for m in block for p in m.parts])


def stored_pass(rows: DataFrame, by: Sequence, block: Sequence[Measure]) -> DataFrame:
    """As `first_pass`, over rows that are partial aggregates under the stored names of the parts."""
    return rows.groupBy(*by).agg(*[MERGE[p.merge](p.stored).alias(p.name) for m in block for p in m.parts])


def finish(parts: DataFrame, by: Sequence[str], block: Sequence[Measure]) -> DataFrame:
    return parts.select(*by, *[m.result.alias(m.name) for m in block])
