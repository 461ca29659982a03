"""Silhouette with Euclidean distances: exact where rows are few, else estimated with an error bound.

The plain figure compares all pairs. Here a bounded sample of rows, drawn within each cluster, is
compared with *all* rows in one scan: a sampled row's distances to every cluster are exact, so
its own silhouette is, and only the mean over rows is estimated. Work is linear in the rows.

Without a sample (`sample=None`) all rows are compared with all rows, block by block in tasks; that work is
quadratic, but no task holds more than a few blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcell.functions import arguments
from starcell.functions.numeric import round_half_up
from starcell.session import write_and_read

SAMPLE = 2_000
# Rows wanted of a cluster however small its share, and the most clusters one call takes.
LEAST_PER_CLUSTER = 50
MOST_CLUSTERS = 1_000
# Rows of a batch compared with the sample at a time.
BLOCK = 256
# Where all rows are compared: rows of a block on the left and on the right side, and sums that a task holds at most.
LEFT_BLOCK, RIGHT_BLOCK = 4_096, 1_024
MOST_SUMS = 1 << 22


def _sizes(labelled: DataFrame, label: str) -> dict:
    found = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLUSTERS + 1).collect()
    if len(found) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    if len(found) < 2:
        raise ValueError("a silhouette needs two clusters or more")
    return {r[0]: r["n"] for r in found}


def _drawn(labelled: DataFrame, label: str, sizes: dict, sample: int, seed: int) -> DataFrame:
    """Rows taken independently, at a rate of their cluster; stored, so that a retry draws no others."""
    whole = sum(sizes.values())
    rates = {c: min(1.0, max(LEAST_PER_CLUSTER, sample * n / whole) / n) for c, n in sizes.items()}
    if whole <= sample:
        rates = dict.fromkeys(sizes, 1.0)
    rate = F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(r)) for c, r in rates.items()])
    rows = labelled.where(F.rand(seed) < rate).withColumn("point", F.monotonically_increasing_id())
    return write_and_read(rows, "silhouette-sample")


def _distance_sums(labelled: DataFrame, columns: Sequence[str], label: str, points: np.ndarray,
                   clusters: Sequence) -> DataFrame:
    """(place, cluster, total): the distances of each sampled point to all rows of each cluster, one scan."""
    places = {c: i for i, c in enumerate(clusters)}
    names = list(columns)
    # One product with (row, 1, its square) gives squared distances.
    ahead = np.column_stack([-2.0 * points, (points ** 2).sum(axis=1), np.ones(len(points))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(points), len(places)))
        seen = False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            of = np.array([places[c] for c in batch.column(label).to_pylist()], dtype=np.int64)
            for start in range(0, len(x), BLOCK):
                part, cluster = x[start:start + BLOCK], of[start:start + BLOCK]
                away = ahead @ np.column_stack([part, np.ones(len(part)), (part ** 2).sum(axis=1)]).T
                np.sqrt(np.maximum(away, 0.0, out=away), out=away)
                held, cluster = np.unique(cluster, return_inverse=True)
                member = np.zeros((len(part), len(held)))
                member[np.arange(len(part)), cluster] = 1.0
                totals[:, held] += away @ member
        if seen:
            place, cluster = np.divmod(np.arange(totals.size), len(places))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(cluster), pa.array(totals.ravel())],
                                             ["place", "cluster", "total"])

    rows = labelled.select(label, *[F.col(n).cast("double").alias(n) for n in names])
    parts = rows.mapInArrow(run, "place long, cluster long, total double")
    return parts.groupBy("place", "cluster").agg(F.sum("total").alias("total"))


def _blocks(rows: DataFrame, names: Sequence[str], label: str, places: dict, size: int, count: int) -> DataFrame:
    """(block, points, clusters): rows packed into blocks of at most `size`, numbered and stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                x = np.column_stack([part.column(n).to_numpy(zero_copy_only=False) for n in names])
                of = np.array([places[c] for c in part.column(label).to_pylist()], dtype="<i4")
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()]), pa.array([of.tobytes()])],
                                                 ["points", "clusters"])

    packed = rows.repartition(max(1, -(-count // size))).mapInArrow(run, "points binary, clusters binary")
    return write_and_read(packed.select(F.monotonically_increasing_id().alias("block"), "*"), "silhouette-blocks")


def _all_distance_sums(labelled: DataFrame, names: Sequence[str], label: str, sizes: dict) -> DataFrame:
    """(place, own, cluster, total): the distances of every row to all rows of each cluster, and its own cluster."""
    places = {c: i for i, c in enumerate(sizes)}
    wide, clusters, whole = len(names), len(sizes), sum(sizes.values())
    rows = write_and_read(labelled.select(label, *[F.col(n).cast("double").alias(n) for n in names]), "silhouette-rows")
    left = _blocks(rows, names, label, places, LEFT_BLOCK, whole)
    right = _blocks(rows, names, label, places, RIGHT_BLOCK, whole).select(
        F.col("points").alias("other_points"), F.col("clusters").alias("other_clusters"))

    def read(points: bytes, of: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(points, dtype="<f8").reshape(-1, wide), np.frombuffer(of, dtype="<i4")

    def line(block: int, own: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
        place = np.repeat(block * LEFT_BLOCK + np.arange(len(own), dtype=np.int64), clusters)
        cluster = np.tile(np.arange(clusters, dtype=np.int64), len(own))
        return pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(np.repeat(own.astype(np.int64), clusters)), pa.array(cluster), pa.array(totals.ravel())],
            ["place", "own", "cluster", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for pair in range(batch.num_rows):
                block, points, of, others, theirs = (batch.column(i)[pair].as_py() for i in range(5))
                if block not in held:
                    x, own = read(points, of)
                    if held and (sum(h[2].size for h in held.values()) + len(x) * clusters) > MOST_SUMS:
                        yield from (line(b, h[1], h[2]) for b, h in held.items())
                        held = {}
                    held[block] = (x, own, np.zeros((len(x), clusters)))
                x, _, totals = held[block]
                y, cluster = read(others, theirs)
                present, cluster = np.unique(cluster, return_inverse=True)
                member = np.zeros((len(y), len(present)))
                member[np.arange(len(y)), cluster] = 1.0
                for start in range(0, len(x), BLOCK):
                    part = x[start:start + BLOCK]
                    away = np.zeros((len(part), len(y)))
                    # Differences, not products: equal rows are 0 apart.
                    for d in range(wide):
                        gap = np.subtract.outer(part[:, d], y[:, d])
                        away += np.square(gap, out=gap)
                    totals[start:start + BLOCK, present] += np.sqrt(away, out=away) @ member
        yield from (line(b, h[1], h[2]) for b, h in held.items())

    # Every block meets every block; a task streams the pairs of its blocks.
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right).select(
        "block", "points", "clusters", "other_points", "other_clusters")
    sums = pairs.mapInArrow(run, "place long, own long, cluster long, total double")
    return sums.groupBy("place", "own", "cluster").agg(F.sum("total").alias("total"))


def euclidean_silhouette(labelled: DataFrame, columns: Sequence[str], label: str, sample: int | None = SAMPLE,
                         seed: int = 42) -> DataFrame:
    """One row: silhouette_score, standard_error, bound_99, sampled_rows, row_count.

    With `sample=None` the score is exact whatever the size: each row is compared with all rows. Up to `sample` rows the score is exact, and both errors are 0. Beyond, about `sample` rows (more where
    clusters are many: at least 50 each are wanted) stand for all; `bound_99` is Hoeffding's, so the
    exact score lies within it in 99 of 100 draws whatever the data, and `standard_error` is measured.
    Cells that are NULL or NaN raise, as does a table of fewer than two clusters. A NULL label is a cluster.
    A row alone in its cluster counts 0, and so does one whose distances are all 0; repeated rows count each.
    The sample (some 2,000 rows of numbers) comes to the driver and goes to every task.
    """
    if sample is not None:
        sample = arguments.whole_number(sample, "sample", 2)
    names = list(columns)
    bad = labelled.select(F.count_if(F.greatest(*[
        (F.col(n).isNull() | F.isnan(F.col(n).cast("double"))).cast("int") for n in names]) == 1).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} rows with missing values")
    labelled = labelled.select(label, *names)
    sizes = _sizes(labelled, label)
    clusters = list(sizes)
    places = {c: i for i, c in enumerate(clusters)}
    session = labelled.sparkSession
    if sample is None:
        sums = _all_distance_sums(labelled, names, label, sizes)
    else:
        drawn = _drawn(labelled, label, sizes, sample, seed)
        local = drawn.toPandas().sort_values("point")
        local[label] = local[label].astype(object).where(local[label].notna(), None)
        points = local[names].to_numpy(dtype=np.float64)
        own = [places[c] for c in local[label]]
        about = session.createDataFrame([(i, c) for i, c in enumerate(own)], "place long, own long")
        sums = _distance_sums(labelled, names, label, points, clusters).join(F.broadcast(about), "place")
    counts = session.createDataFrame([(places[c], n) for c, n in sizes.items()], "cluster long, n long")
    away = sums.join(F.broadcast(counts), "cluster")
    is_own = F.col("cluster") == F.col("own")
    rows = away.groupBy("place", "own").agg(
        F.max(F.when(is_own, F.col("n"))).alias("n"),
        F.max(F.when(is_own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~is_own, F.col("total") / F.col("n"))).alias("b"))
    larger = F.greatest("a", "b")
    value = F.when((F.col("n") == 1) | (larger == 0), 0.0).otherwise((F.col("b") - F.col("a")) / larger)
    strata = rows.groupBy("own").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m"), F.avg(value).alias("mean"),
                                     F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"))
    strata = strata.withColumn("share", F.col("n") / F.lit(sum(sizes.values())))
    spread = F.col("share") * F.col("share") / F.col("m")
    open_ = F.col("m") < F.col("n")
    return strata.agg(
        round_half_up(F.sum(F.col("share") * F.col("mean")), 4).alias("silhouette_score"),
        round_half_up(F.sqrt(F.sum(spread * F.col("variance") * (1 - F.col("m") / F.col("n")))), 6).alias("standard_error"),
        # A silhouette lies in an interval of length 2.
        round_half_up(F.sqrt(F.sum(F.when(open_, spread).otherwise(0.0)) * (4 * math.log(2 / 0.01) / 2)), 6).alias("bound_99"),
        F.sum("m").alias("sampled_rows"), F.lit(sum(sizes.values())).cast("bigint").alias("row_count"))
