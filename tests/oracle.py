"""Run a registered query and its SQL, and compare them cell by cell."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Result types that count as the same.
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (repr(value) if value or math.copysign(1, value) > 0
                                                 else "-0.0")
    return repr(value)


def compare(spark, con, name, query, sql, sf_dir, need_rows=False) -> tuple[str, float, float]:
    """'' when equal, else what differs; and the seconds of both sides."""
    start = time.time()
    frame = query(spark, sf_dir)
    rows = [r.asDict() for r in frame.collect()]
    middle = time.time()
    if need_rows and not rows:
        return "no rows", middle - start, 0.0
    if sql is None:
        return "", middle - start, 0.0
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    types = {c[0]: str(c[1]) for c in cursor.description}
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    end = time.time()
    spent = middle - start, end - middle
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}", *spent
    bad = [f"{f}:{t} vs {types[f]}" for f, t in frame.dtypes if SAME_TYPE.get(t, t) != types[f]]
    if bad:
        return f"types {bad}", *spent
    if len(rows) != len(want):
        return f"{len(rows)} rows vs {len(want)}", *spent
    order = sorted(names)
    left = sorted([cell(r[c]) for c in order] for r in rows)
    right = sorted([cell(r[c]) for c in order] for r in want)
    if left != right:
        off = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(off)} rows differ, e.g. {order}\n   {off[0][0]}\n   {off[0][1]}", *spent
    return "", *spent
