"""Stored partial aggregates: the same answers as the fact gives, and when they must not be asked."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from starcell.operators import loading, telemetry
from starcell.operators.cube import CustomerCube, NetworkCube
from starcell.plans import measures
from starcell.plans.marts import KPIS
from starcell.plans.rollups import NETWORK_SHAPES, Rollup, Rollups
from starcell.sources.warehouse import Warehouse
from tests.samples import NETWORK_CSV, account, accounts

DIGITS = dict.fromkeys(KPIS, 3)
# Three days, two hours a day and two minutes an hour, of six cells; one cell is far busier than the others.
TIMES = [f"2026-08-0{d} {h}:{m}:00" for d in (3, 4, 5) for h in ("09", "17") for m in ("05", "50")]
CELLS = [*range(6)]


def reading(time: str, cell: int):
    value = cell * 7 + TIMES.index(time) * 3
    return (time, f"Cell_{cell}", ("North", "South", "East")[cell % 3], "5G" if cell % 2 else "LTE", f"{10 + value}.125",
            f"{100 + value}.5", "0.125", f"{value % 9}.25", f"-{60 + value % 20}.5", "97.25", str(value))


def raw(spark, times):
    return spark.createDataFrame([reading(t, c) for t in times for c in CELLS], NETWORK_CSV)


def people(spark, numbers):
    return accounts(spark, [account(n, Contract=("One year", "Two year")[n % 2], Churn=("Yes", "No")[n % 3 > 0],
                                    gender=("Male", "Female")[n % 5 > 1]) for n in numbers])


def lines(df):
    return sorted(tuple(r) for r in df.collect())


def sources(df):
    """Files that a frame reads; plans cut long paths short."""
    return " ".join(df.inputFiles())


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    """Both marts, loaded in two goes."""
    house = Warehouse(spark, str(tmp_path_factory.mktemp("rollups") / "warehouse"))
    for reset, times, numbers in ((True, TIMES[:7], range(1, 60)), (False, TIMES[7:], range(60, 90))):
        loading.load_network(house, raw(spark, times), reset, rollup_digits=DIGITS)
        loading.load_customer(house, people(spark, numbers), reset, rollup_digits=(2, 2))
    return house


NETWORK_ASKS = [
    lambda c: c.summary(), lambda c: c.rollup("hour"), lambda c: c.rollup("day"), lambda c: c.rollup("week"),
    lambda c: c.rollup("month"), lambda c: c.rollup("region"), lambda c: c.rollup("technology"),
    lambda c: c.rollup("cell_id"), lambda c: c.drilldown("North"), lambda c: c.slice("date", "2026-08-04"),
    lambda c: c.slice("hour", 17), lambda c: c.slice("region", "South"), lambda c: c.slice("date", "2030-01-01"),
    lambda c: c.dice(region="North", technology="LTE"), lambda c: c.dice(cell_id="Cell_4"),
    lambda c: telemetry.cell_summary(c.star, DIGITS), lambda c: telemetry.cell_detail(c.star, "Cell_3"),
    lambda c: telemetry.list_cells(c.star, region="north"),
]


def test_network_rollups_answer_as_the_fact(house):
    stored = NetworkCube(house.network_star(), DIGITS)
    # Dimensions that may not be broadcast are joined after the parts have been merged.
    far = replace(stored, star=stored.star.with_broadcast_rows(0))
    fact = NetworkCube(house.network_star(rollups=False), DIGITS)
    for place, ask in enumerate(NETWORK_ASKS):
        want = lines(ask(fact))
        assert lines(ask(stored)) == want
        if place % 4 == 0:
            assert lines(ask(far)) == want
        assert "fact_network_kpi" not in sources(ask(stored))
        assert "fact_network_kpi" in sources(ask(fact))


def test_smallest_table_is_asked(house):
    cube = NetworkCube(house.network_star(), DIGITS)
    assert "rollup_network_hour" in sources(cube.rollup("hour"))
    assert "rollup_network_day" in sources(cube.rollup("cell_id"))
    smallest = min(cube.star.rollups.sizes(), key=cube.star.rollups.sizes().get)
    assert smallest in sources(cube.rollup("day"))


def test_questions_below_the_grain_go_to_the_fact(house):
    cube = NetworkCube(house.network_star(), DIGITS)
    fact = NetworkCube(house.network_star(rollups=False), DIGITS)
    for ask in (lambda c: c.rollup("minute"), lambda c: c.slice("minute", 5), lambda c: c.high_call_drop(4.0),
                lambda c: c.dice(latency_gt=30), lambda c: c.dice(start_time="2026-08-04 09:05:00"),
                lambda c: c.drilldown("North", "Cell_0"), lambda c: telemetry.first_baselines(c.star)):
        assert lines(ask(cube)) == lines(ask(fact))
        assert "fact_network_kpi" in sources(ask(cube))
    # Other decimals than those declared at the load are other sums.
    assert "fact_network_kpi" in sources(NetworkCube(house.network_star()).rollup("day"))


def test_customer_rollup_answers_as_the_fact(house):
    stored = CustomerCube(house.customer_star(), (2, 2))
    fact = CustomerCube(house.customer_star(rollups=False), (2, 2))
    for ask in (lambda c: c.summary(), lambda c: c.rollup(), lambda c: c.rollup("contract"), lambda c: c.rollup("gender"),
                lambda c: c.drilldown("13-24 months"), lambda c: c.slice("tenure_band", "25-48 months"),
                lambda c: c.slice("senior_citizen", 0), lambda c: c.slice("churn_flag", "yes"),
                lambda c: c.dice(contract="One year", churn_flag="no", gender="Male", tenure_band="0-12 months"),
                lambda c: c.dice(contract="Month-to-month")):
        assert lines(ask(stored)) == lines(ask(fact))
        assert "fact_customer_churn" not in sources(ask(stored))


def test_sketches_count_cells_without_their_keys(house):
    cube = NetworkCube(house.network_star(), DIGITS)
    near, exact = cube.summary(approximate=0.02), cube.summary().first()
    assert "fact_network_kpi" not in sources(near)
    assert near.first().asDict() == exact.asDict()
    # Sketches of a smaller error are not stored.
    assert "fact_network_kpi" in sources(cube.summary(approximate=0.005))
    day = measures.members("cells", "cell_key")
    rows = house.network_star().aggregate([day], ["region"]).collect()
    assert {r.region: r.cells for r in rows} == {"North": 2, "South": 2, "East": 2}


def test_a_replaced_fact_is_not_answered_from_rollups(house):
    star = house.network_star()
    half = NetworkCube(replace(star, fact=star.fact.where("technology_key = 1")), DIGITS)
    assert half.summary().first().total_observations == star.fact.where("technology_key = 1").count()


def test_stale_rollups_are_left_out_and_made_anew(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "warehouse"))
    loading.load_network(house, raw(spark, TIMES[:3]), rollup_digits=DIGITS)
    loading.load_network(house, raw(spark, TIMES[3:5]), reset=False)
    cube = NetworkCube(house.network_star(), DIGITS)
    assert "fact_network_kpi" in sources(cube.rollup("day"))
    assert cube.summary().first().total_observations == 5 * len(CELLS)
    loading.load_network(house, raw(spark, TIMES[5:6]), reset=False, rollup_digits=DIGITS)
    cube, fact = (NetworkCube(house.network_star(rollups=r), DIGITS) for r in (True, False))
    assert "fact_network_kpi" not in sources(cube.rollup("day"))
    assert lines(cube.rollup("day")) == lines(fact.rollup("day"))
    # A load that replaces the fact empties its rollups first.
    loading.load_network(house, raw(spark, TIMES[6:12]))
    assert house.read("rollup_network_day").count() == 0
    assert "fact_network_kpi" in sources(NetworkCube(house.network_star(), DIGITS).rollup("day"))


def test_nulls_and_no_rows(house):
    """NULL values stay out of means, extremes and sketches, and an empty fact has an empty rollup."""
    star = house.network_star(rollups=False)
    shape = NETWORK_SHAPES["rollup_network_day"]
    block = [measures.row_count("n"), measures.mean("avg", "latency_ms", 3), measures.lowest("low", "latency_ms"),
             measures.members("loads", "active_connections")]
    for fact in (star.fact.withColumn("latency_ms", F.when(F.col("latency_ms") < 30, F.col("latency_ms"))),
                 star.fact.where("false")):
        plain = replace(star, fact=fact)
        table = Rollup("day", shape.build(plain, block), shape.keys, shape.names, shape.grain)
        kept = replace(plain, rollups=Rollups(fact, [table]))
        assert kept.answering(block)[0] is not kept
        for by in ([], ["region"], ["date"]):
            assert lines(kept.aggregate(block, by)) == lines(plain.aggregate(block, by))
