"""Checks on what a caller passes to an operator, made before any job starts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping

FLAG_WORDS = {"yes": 1, "1": 1, "true": 1, "no": 0, "0": 0, "false": 0}


def tidy_name(name: str) -> str:
    """Trimmed lower case with spaces and hyphens as underscores."""
    return re.sub(r"[ -]", "_", str(name).strip().lower())


def pick(name: str, allowed: Iterable[str], what: str) -> str:
    """The tidy name if it is an allowed one, else an error that lists them."""
    allowed = list(allowed)
    tidy = tidy_name(name)
    if tidy not in allowed:
        raise ValueError(f"unknown {what} {name!r}; expected one of {sorted(allowed)}")
    return tidy


def given_filters(filters: Mapping | None, extra: Mapping) -> dict:
    """Both mappings together without the None and empty-text entries."""
    merged = {**(filters or {}), **extra}
    return {k: v for k, v in merged.items() if v is not None and v != ""}


def number(value, what: str, low: float | None = None, high: float | None = None) -> float:
    try:
        parsed = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{what} must be numeric, got {value!r}") from None
    if math.isnan(parsed):
        raise ValueError(f"{what} must be a number, got NaN")
    if (low is not None and parsed < low) or (high is not None and parsed > high):
        raise ValueError(f"{what} must lie in [{low}, {high}], got {value!r}")
    return parsed


def whole_number(value, what: str, low: int | None = None, high: int | None = None) -> int:
    parsed = number(value, what, low, high)
    if parsed != int(parsed):
        raise ValueError(f"{what} must be a whole number, got {value!r}")
    return int(parsed)


def flag(value, what: str) -> int:
    word = str(value).strip().lower()
    if word not in FLAG_WORDS:
        raise ValueError(f"{what} must be one of {sorted(FLAG_WORDS)}, got {value!r}")
    return FLAG_WORDS[word]


def text(value) -> str:
    return str(value).strip()
