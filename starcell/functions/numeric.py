"""Rounding, clamping and exact fixed-point arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def round_half_up(value, places: int) -> Column:
    """Round half away from zero.

    Built from floor so that every engine with IEEE doubles gives the same
    digits; the trailing zero turns -0.0 into 0.0.
    """
    value = as_column(value)
    power = float(10**places)
    return F.signum(value) * F.floor(F.abs(value) * power + 0.5) / power + F.lit(0.0)


def fixed_text(value, places: int) -> Column:
    """Text with exactly `places` decimals, made from whole numbers."""
    value = as_column(value)
    units = F.floor(F.abs(value) * float(10**places) + 0.5)
    sign = F.when((value < 0) & (units > 0), "-").otherwise("")
    if places == 0:
        return F.concat(sign, units.cast("string"))
    whole = F.floor(units / 10**places).cast("string")
    return F.concat(sign, whole, F.lit("."), F.lpad((units % 10**places).cast("string"), places, "0"))


def clamp(value, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (greatest/least alone would skip it)."""
    value = as_column(value)
    limited = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNotNull(), limited)


def fixed_point(value, digits: int) -> Column:
    """A double with at most `digits` decimals as a whole number of 10^-digits units."""
    return F.rint(as_column(value) * float(10**digits)).cast("bigint")


# Exact sums split a unit count into two whole numbers at this bit.
SPLIT_BITS = 20


def sum_parts(value, digits: int) -> tuple[Column, Column]:
    """Sums of the upper and the lower bits of the unit counts.

    Both stay plain bigint sums, which are fast, and together they hold totals far
    beyond bigint: the lower part alone would need 8e12 rows to overflow.
    """
    units = fixed_point(value, digits)
    low = units.bitwiseAND(F.lit(2**SPLIT_BITS - 1))
    return F.sum(F.shiftright(units, SPLIT_BITS)), F.sum(low)


def join_parts(high, low) -> Column:
    """The total of `sum_parts` as decimal(38,0)."""
    high, low = (as_column(c).cast("decimal(38,0)") for c in (high, low))
    return (high * F.lit(2**SPLIT_BITS) + low).cast("decimal(38,0)")


def exact_sum(value, digits: int | None) -> Column:
    """Sum that does not depend on row order when the decimals are known."""
    if digits is None:
        return F.sum(as_column(value).cast("double"))
    return join_parts(*sum_parts(value, digits))


def from_units(total, digits: int | None) -> Column:
    """Turn a total made by `exact_sum` back into a double."""
    total = as_column(total).cast("double")
    return total if digits is None else total / float(10**digits)


def exact_mean(total, count, digits: int | None) -> Column:
    """Mean from an `exact_sum` total: divide by the count first, then by the scale."""
    mean = F.try_divide(as_column(total).cast("double"), as_column(count))
    return mean if digits is None else mean / float(10**digits)
