"""Cube semantics: reconciliation, empty results, wrong arguments and large dimensions."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from driver.tables import customer_cube, network_cube
from starcell.operators import telemetry
from starcell.operators.cube import NetworkCube

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def customers(spark):
    return customer_cube(spark, SF_DIR)


@pytest.fixture(scope="module")
def network(spark):
    return network_cube(spark, SF_DIR)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bands_sum_to_the_summary(customers):
    whole = customers.summary().first()
    bands = customers.rollup().collect()
    assert sum(b.customer_count for b in bands) == whole.total_customers
    assert sum(b.churned_customers for b in bands) == whole.churned_customers
    assert [b.tenure_band for b in bands] == ["0-12 months", "13-24 months", "25-48 months", "49-72 months"]


def test_contracts_sum_to_their_band(customers):
    band = {b.tenure_band: b for b in customers.rollup().collect()}["13-24 months"]
    parts = customers.drilldown("13-24 months").collect()
    assert sum(p.customer_count for p in parts) == band.customer_count
    counts = [p.customer_count for p in parts]
    assert counts == sorted(counts, reverse=True)


@pytest.mark.parametrize("level", ["day", "week", "month", "region", "technology"])
def test_levels_sum_to_the_summary(network, level):
    total = network.rollup(level).agg(F.sum("observation_count")).first()[0]
    assert total == network.summary().first().total_observations


def test_high_drop_counts_observations(network):
    counted = network.high_call_drop(5.0).agg(F.sum("observation_count")).first()[0]
    assert counted == network.star.fact.where("call_drop_rate_pct > 5.0").count()


def test_high_drop_order(network):
    found = [(-r.avg_call_drop_rate_pct, -r.observation_count) for r in network.high_call_drop(7).collect()]
    assert found == sorted(found)


def test_no_rows_left_gives_zeros(network, customers):
    row = network.dice(region="ASIA", call_drop_rate_gt=99).first()
    assert row.observation_count == 0 and row.avg_latency_ms == 0.0
    row = customers.slice("brand", "no such brand").first()
    assert row.customer_count == 0 and row.churn_rate_pct == 0.0 and row.churned_count == 0
    assert network.high_call_drop(100).count() == 0


def test_empty_fact(network):
    empty = NetworkCube(replace(network.star, fact=network.star.fact.where("false")), network.digits,
                        network.counted, network.counted_names)
    row = empty.summary().first()
    assert row.total_observations == 0 and row.number_of_cells == 0 and row.avg_latency_ms == 0.0
    assert empty.rollup("day").count() == 0


def test_null_kpi_is_left_out_of_its_mean(network):
    fact = network.star.fact.withColumn(
        "latency_ms", F.when(F.col("latency_ms") <= 100, F.col("latency_ms")))
    cube = NetworkCube(replace(network.star, fact=fact), network.digits, network.counted,
                       network.counted_names)
    want = fact.agg(F.round(F.avg("latency_ms"), 2)).first()[0]
    row = cube.summary().first()
    assert row.avg_latency_ms == pytest.approx(want, abs=0.0051)
    assert row.total_observations == fact.count()


def test_empty_dice_is_the_summary(network):
    whole, same = network.summary().first(), network.dice(region=None, technology="").first()
    assert same.observation_count == whole.total_observations
    assert same.avg_throughput_mbps == whole.avg_throughput_mbps


def test_approximate_summary(network):
    exact, near = network.summary().first(), network.summary(approximate=0.02).first()
    assert near.avg_latency_ms == exact.avg_latency_ms
    assert near.number_of_cells == pytest.approx(exact.number_of_cells, rel=0.1)


def test_at_least_connections(network):
    bound = 300
    want = network.star.fact.where(f"active_connections >= {bound}").count()
    for name in ("min_active_connections", "active_connections_gt"):
        assert network.dice({name: bound}).first().observation_count == want


@pytest.mark.parametrize("call", [
    lambda c, n: c.rollup("no such group"),
    lambda c, n: c.drilldown("5-10 months"),
    lambda c, n: c.slice("no_such", 1),
    lambda c, n: c.slice("contract", "Weekly"),
    lambda c, n: c.slice("size", "Yes"),
    lambda c, n: c.dice(churn_flag="maybe"),
    lambda c, n: n.rollup("decade"),
    lambda c, n: n.drilldown("ATLANTIS"),
    lambda c, n: n.slice("technology", "6G"),
    lambda c, n: n.slice("timestamp", "now"),
    lambda c, n: n.slice("date", "June 1st"),
    lambda c, n: n.dice(latency_gt="slow"),
    lambda c, n: n.dice(no_such_filter=1),
    lambda c, n: n.high_call_drop(101),
    lambda c, n: n.high_call_drop(float("nan")),
    lambda c, n: n.high_call_drop("many"),
    lambda c, n: telemetry.cell_telemetry(n.star, "x", limit=0),
    lambda c, n: telemetry.cell_telemetry(n.star, "no such cell"),
])
def test_wrong_arguments(customers, network, call):
    with pytest.raises(ValueError):
        call(customers, network)


def test_large_dimensions_give_the_same(customers, network):
    """With no dimension allowed to be broadcast, all are joined after aggregation."""
    far = replace(customers, star=customers.star.with_broadcast_rows(0))
    for run in (lambda c: c.rollup("contract"), lambda c: c.rollup(),
                lambda c: c.drilldown("0-12 months"), lambda c: c.slice("contract", "5-LOW"),
                lambda c: c.dice(contract="5-LOW", brand="Brand#3", tenure_band="49-72 months"),
                lambda c: c.dice(contract="2-HIGH", churn_flag="no")):
        assert rows(run(far)) == rows(run(customers))
    wide = replace(network, star=network.star.with_broadcast_rows(0))
    for run in (lambda c: c.high_call_drop(4), lambda c: c.summary(), lambda c: c.drilldown("ASIA"),
                lambda c: c.dice(region="ASIA", latency_gt=50),
                lambda c: telemetry.cell_detail(c.star), lambda c: telemetry.first_baselines(c.star)):
        assert rows(run(wide)) == rows(run(network))


def test_large_dimension_joins_after_aggregation(customers):
    far = replace(customers, star=customers.star.with_broadcast_rows(0))
    plan = far.rollup("contract")._jdf.queryExecution().optimizedPlan().toString()
    # Reading from the top: final aggregate, join, and below it the aggregate per key.
    assert plan.index("Aggregate") < plan.index("Join Inner") < plan.rindex("Aggregate")


def test_filters_reach_the_scan(customers):
    plan = customers.slice("tenure_band", "13-24 months")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,12)" in plan and "LessThanOrEqual(p_size,24)" in plan


def test_hot_key(network):
    """One cell with most of the fact: same totals, and one row per task leaves the map side."""
    fact = network.star.fact
    hot = fact.withColumn("l_suppkey", F.when(F.col("latency_ms") > 60, F.lit(1)).otherwise(F.col("l_suppkey")))
    cube = NetworkCube(replace(network.star, fact=hot), network.digits, network.counted,
                       network.counted_names)
    far = replace(cube, star=cube.star.with_broadcast_rows(0))
    assert rows(far.high_call_drop(1)) == rows(cube.high_call_drop(1))
