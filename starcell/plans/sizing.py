"""Broadcast only what has been counted and weighed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What one executor may hold of a broadcast side. Larger sides are joined by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_TEXT_BYTES = 64 * 2**20


def fits_broadcast(side: DataFrame, max_rows: int = BROADCAST_ROWS,
                   max_bytes: int = BROADCAST_TEXT_BYTES) -> bool:
    """Whether a side is proven small: few rows, and little text in them.

    The count comes first; on an unfiltered Parquet table it reads footers alone.
    Only a side with few rows has its text lengths summed. Nested columns are not
    broadcast, as their size is open.
    """
    kinds = dict(side.dtypes)
    if any(kind.startswith(("array", "map", "struct", "binary")) for kind in kinds.values()):
        return False
    if side.count() > max_rows:
        return False
    texts = [F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)).cast("bigint")
             for name, kind in kinds.items() if kind == "string"]
    if not texts:
        return True
    held = side.agg(*[F.sum(length) for length in texts]).first()
    return sum(n or 0 for n in held) <= max_bytes


def broadcast_if_small(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a side that is proven small, else leave the join to AQE."""
    return F.broadcast(side) if fits_broadcast(side, max_rows) else side
