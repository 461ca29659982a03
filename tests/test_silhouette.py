"""The Euclidean silhouette against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driver import mining_queries
from starcell.operators import silhouette
from starcell.operators.silhouette import euclidean_silhouette


def brute(x, labels):
    """Mean silhouette by the definition."""
    away = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    values = []
    for i, label in enumerate(labels):
        same = np.array([o == label for o in labels])
        if same.sum() == 1:
            values.append(0.0)
            continue
        a = away[i][same].sum() / (same.sum() - 1)
        b = min(away[i][np.array([o == c for o in labels])].mean() for c in set(labels) if c != label)
        values.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(values))


def frame(spark, x, labels):
    return spark.createDataFrame([(label, *map(float, row)) for label, row in zip(labels, x)],
                                 "label string, a double, b double").repartition(5)


def blobs(sizes, seed=3):
    draw = np.random.default_rng(seed)
    x = np.vstack([draw.normal((4 * i, -3 * i), 2.0, (n, 2)) for i, n in enumerate(sizes)])
    return x, [f"c{i}" for i, n in enumerate(sizes) for _ in range(n)]


def test_few_rows_are_exact(spark):
    """With a cluster of one row, equal rows in two clusters, and a cluster without a name."""
    x, labels = blobs((40, 25, 1))
    x = np.vstack([x, x[:3], x[:3]])
    labels += [None] * 3 + ["c0"] * 3
    row = euclidean_silhouette(frame(spark, x, labels), ["a", "b"], "label").first()
    assert row.silhouette_score == pytest.approx(brute(x, labels), abs=5.1e-5)
    assert (row.standard_error, row.bound_99, row.sampled_rows, row.row_count) == (0.0, 0.0, len(x), len(x))


def test_all_rows_equal(spark):
    row = euclidean_silhouette(frame(spark, np.ones((8, 2)), ["p", "q"] * 4), ["a", "b"], "label").first()
    assert row.silhouette_score == 0.0


def test_sampled_rows_keep_the_bound(spark):
    """A hot cluster with most rows and a small one; the sample is a tenth of the table."""
    x, labels = blobs((1800, 300, 60))
    row = euclidean_silhouette(frame(spark, x, labels), ["a", "b"], "label", sample=200).first()
    off = abs(row.silhouette_score - brute(x, labels))
    assert 150 < row.sampled_rows < 400 and row.row_count == len(x)
    assert 0 < row.standard_error < row.bound_99 < 0.3
    assert off <= row.bound_99 and off <= 4 * row.standard_error + 1e-4


def test_all_rows_are_compared(spark, monkeypatch):
    """Without a sample, over several blocks on both sides, with equal rows and clusters of one row and without a name."""
    monkeypatch.setattr(silhouette, "LEFT_BLOCK", 300)
    monkeypatch.setattr(silhouette, "RIGHT_BLOCK", 170)
    monkeypatch.setattr(silhouette, "MOST_SUMS", 2_000)
    x, labels = blobs((1800, 600, 1))
    x = np.vstack([x, x[:3], x[:3]])
    labels += [None] * 3 + ["c0"] * 3
    row = euclidean_silhouette(frame(spark, x, labels), ["a", "b"], "label", sample=None).first()
    assert row.silhouette_score == pytest.approx(brute(x, labels), abs=5.1e-5)
    assert (row.standard_error, row.bound_99, row.sampled_rows, row.row_count) == (0.0, 0.0, len(x), len(x))


def test_sites_are_not_sampled(spark, tmp_path):
    """More sites than any sample the query ever took."""
    sites = 11_000
    spark.range(2).select(F.col("id").cast("int").alias("r_regionkey"),
                          F.concat(F.lit("R"), "id").alias("r_name")).write.parquet(f"{tmp_path}/region.parquet")
    spark.range(2).select(F.col("id").cast("int").alias("n_nationkey"),
                          F.col("id").cast("int").alias("n_regionkey")).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(sites).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"),
                              (F.col("id") % 2).cast("int").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(sites).select(
        F.col("id").alias("l_suppkey"), F.lit("F").alias("l_linestatus"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("l_shipdate"), (F.col("id") % 2 * 9.0).alias("l_quantity"),
        (F.col("id") % 1000 * 10.0).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"),
        F.lit(0.01).alias("l_tax")).write.parquet(f"{tmp_path}/lineitem.parquet")
    row = mining_queries.site_silhouette(spark, str(tmp_path)).first()
    assert (row.standard_error, row.bound_99, row.sampled_rows, row.row_count) == (0.0, 0.0, sites, sites)


def test_wrong_tables(spark):
    x, labels = blobs((5, 5))
    with pytest.raises(ValueError, match="two clusters"):
        euclidean_silhouette(frame(spark, x, ["same"] * 10), ["a", "b"], "label")
    with pytest.raises(ValueError, match="two clusters"):
        euclidean_silhouette(frame(spark, x, labels).where("false"), ["a", "b"], "label")
    x[3, 1] = np.nan
    with pytest.raises(ValueError, match="missing"):
        euclidean_silhouette(frame(spark, x, labels), ["a", "b"], "label")
