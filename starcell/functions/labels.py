"""Threshold labels: an ordered list of cut points becomes one CASE expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from starcell.functions.numeric import as_column

# Upper bound (inclusive) of each tenure band, the last one open.
TENURE_BANDS = (
    (12, "0-12 months"),
    (24, "13-24 months"),
    (48, "25-48 months"),
    (None, "49-72 months"),
)

# Lower bounds of the health bands.
HEALTH_BANDS = (
    (80.0, "OPTIMAL HEALTH"),
    (60.0, "DEGRADED PERFORMANCE"),
    (None, "CRITICAL CONGESTION"),
)

# A rule is strong when its lift is above the bound.
RULE_STRENGTHS = (
    (2.0, "High Affinity"),
    (1.3, "Moderate Affinity"),
    (None, "Baseline"),
)


def _first_match(tests: Sequence[tuple[Column | None, str]]) -> Column:
    label = F.lit(tests[-1][1])
    for test, name in reversed(tests[:-1]):
        label = F.when(test, F.lit(name)).otherwise(label)
    return label


def band_label(value, bands=TENURE_BANDS) -> Column:
    """Label of the first band whose upper bound is not exceeded; NULL takes the last."""
    value = as_column(value)
    return _first_match([(None if up is None else value <= up, name) for up, name in bands])


def band_filter(value, name: str, bands=TENURE_BANDS) -> Column:
    """Filter on a band as plain bounds, which reach the file scan; CASE would not.

    The last band also keeps NULL, as its label does.
    """
    value = as_column(value)
    names = [n for _, n in bands]
    place = names.index(name)
    upper = bands[place][0]
    lower = bands[place - 1][0] if place else None
    if upper is None:
        return F.lit(True) if lower is None else (value > lower) | value.isNull()
    return (value <= upper) if lower is None else (value > lower) & (value <= upper)


def health_band(score) -> Column:
    score = as_column(score)
    return _first_match([(None if low is None else score >= low, n) for low, n in HEALTH_BANDS])


def rule_strength(lift) -> Column:
    lift = as_column(lift)
    return _first_match([(None if low is None else lift > low, n) for low, n in RULE_STRENGTHS])
