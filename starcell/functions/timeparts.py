"""Time buckets and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starcell.functions.numeric import as_column

STAMP = "yyyy-MM-dd HH:mm:ss"

# Output text of each roll-up level.
LEVEL_FORMATS = {
    "minute": STAMP,
    "hour": STAMP,
    "day": "yyyy-MM-dd",
    "week": "yyyy-MM-dd",
    "month": "yyyy-MM",
}


def bucket(ts, level: str) -> Column:
    """Start of the bucket, still a timestamp: group on this, print only afterwards."""
    return F.date_trunc(level, as_column(ts))


def bucket_text(start, level: str) -> Column:
    return F.date_format(as_column(start), LEVEL_FORMATS[level])


def stamp_text(ts) -> Column:
    return F.date_format(as_column(ts), STAMP)


def calendar_parts(ts) -> dict[str, Column]:
    ts = as_column(ts)
    return {
        "date": F.date_format(ts, "yyyy-MM-dd"),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "day": F.day(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
    }
