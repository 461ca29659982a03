import math

import pytest
from pyspark.sql import functions as F

from starcell.functions import arguments
from starcell.functions.labels import band_filter, band_label, health_band, rule_strength
from starcell.functions.numeric import (
    clamp,
    exact_mean,
    exact_sum,
    fixed_text,
    from_units,
    round_half_up,
)


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_round_half_up_is_away_from_zero(spark):
    rows = column(spark, [2.5, -2.5, 0.125, -0.125, -0.001, None]).select(
        round_half_up("x", 0).alias("a"), round_half_up("x", 2).alias("b")).collect()
    assert [r.a for r in rows] == [3.0, -3.0, 0.0, 0.0, 0.0, None]
    assert [r.b for r in rows] == [2.5, -2.5, 0.13, -0.13, 0.0, None]
    assert math.copysign(1, rows[4].b) == 1.0


def test_clamp_keeps_null(spark):
    rows = column(spark, [-5.0, 5.0, 15.0, None]).select(clamp("x", 0, 10).alias("y")).collect()
    assert [r.y for r in rows] == [0.0, 5.0, 10.0, None]


def test_fixed_text(spark):
    rows = column(spark, [0.0, 12.345, -0.004, -1.5, 99.999]).select(
        fixed_text("x", 2).alias("a"), fixed_text("x", 0).alias("b")).collect()
    assert [r.a for r in rows] == ["0.00", "12.35", "0.00", "-1.50", "100.00"]
    assert [r.b for r in rows] == ["0", "12", "0", "-2", "100"]


@pytest.mark.parametrize("digits", [0, 2, 6])
def test_exact_sum_of_negatives_and_nulls(spark, digits):
    values = [-1.25, 2.5, None, 1e9, -3.0]
    row = column(spark, values).agg(
        from_units(exact_sum("x", digits), digits).alias("s"), F.count("x").alias("n"),
        exact_mean(exact_sum("x", digits), F.count("x"), digits).alias("m")).first()
    want = sum(round(v * 10**digits) for v in values if v is not None) / 10**digits
    assert row.s == want and row.n == 4 and row.m == pytest.approx(want / 4)


def test_exact_sum_passes_bigint(spark):
    big = spark.range(3000).select((F.lit(9e12) + F.col("id")).alias("x"))
    total = big.agg(exact_sum("x", 3).alias("s")).first().s
    assert int(total) == sum((9 * 10**12 + i) * 1000 for i in range(3000)) > 2**63


def test_empty_mean_is_null(spark):
    row = column(spark, []).agg(exact_mean(exact_sum("x", 2), F.count("x"), 2).alias("m")).first()
    assert row.m is None


def test_bands_at_their_edges(spark):
    rows = column(spark, [0, 12, 13, 24, 25, 48, 49, 72, None], "int")
    labels = [r.b for r in rows.select(band_label("x").alias("b")).collect()]
    assert labels == ["0-12 months"] * 2 + ["13-24 months"] * 2 + ["25-48 months"] * 2 + ["49-72 months"] * 3
    for name in set(labels):
        by_range = rows.where(band_filter("x", name)).count()
        assert by_range == labels.count(name)


def test_health_and_strength_labels(spark):
    rows = column(spark, [80.0, 79.9, 60.0, 59.9]).select(health_band("x").alias("b")).collect()
    assert [r.b for r in rows] == ["OPTIMAL HEALTH", "DEGRADED PERFORMANCE", "DEGRADED PERFORMANCE",
                                  "CRITICAL CONGESTION"]
    rows = column(spark, [2.1, 2.0, 1.3]).select(rule_strength("x").alias("b")).collect()
    assert [r.b for r in rows] == ["High Affinity", "Moderate Affinity", "Baseline"]


def test_arguments():
    assert arguments.tidy_name(" Internet-Service ") == "internet_service"
    assert arguments.given_filters({"a": None, "b": ""}, {"c": 0}) == {"c": 0}
    assert arguments.flag("TRUE", "f") == 1
    for wrong in ("x", None, float("nan"), 101):
        with pytest.raises(ValueError):
            arguments.number(wrong, "threshold", 0, 100)
    with pytest.raises(ValueError):
        arguments.flag("maybe", "f")
    with pytest.raises(ValueError):
        arguments.whole_number(1.5, "limit")
