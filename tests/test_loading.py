"""Quality reports and loads, with bad rows put in on purpose."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driver.raw import raw_network
from starcell.operators import clusters, loading, quality, telemetry
from starcell.operators.cube import CustomerCube, NetworkCube
from starcell.plans.marts import network_star
from starcell.plans.ordering import number_in_order, totals_before
from starcell.sources import files
from starcell.sources.warehouse import Warehouse
from tests.samples import NETWORK_CSV, account, accounts, network_csv_rows


def network_raw(spark, rows=None):
    return spark.createDataFrame(network_csv_rows() if rows is None else rows, NETWORK_CSV)


def lines(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def house(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"))


def test_missing_columns_are_listed(spark):
    with pytest.raises(ValueError, match="latency_ms.*region"):
        quality.require_columns(network_raw(spark).drop("region", "latency_ms"), files.NETWORK_COLUMNS)


def test_null_and_duplicate_counts(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (1, "a"), (2, "b"), (None, None)], "k int, v string")
    assert lines(quality.null_counts(df)) == [("k", 1), ("v", 2)]
    assert quality.surplus_duplicates(df, ["k"]).first().duplicate_count == 2
    assert lines(quality.duplicate_keys(df, ["k", "v"])) == [(1, "a", 2)]
    assert quality.surplus_duplicates(df.where("false"), ["k"]).first().duplicate_count == 0


def test_rules_pass_on_null_unless_required(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-1.0,)], "x double")
    rules = [quality.at_least("x", 0), quality.required("x")]
    assert lines(quality.rule_report(df, rules)) == [("x >= 0", 1), ("x not null", 1)]
    good, bad = quality.split_by_rules(df, rules)
    assert lines(good) == [(5.0,)]
    assert {tuple(r.broken_rules) for r in bad.collect()} == {("x not null",), ("x >= 0",)}


def test_domain_violations(spark):
    df = spark.createDataFrame([("North", "5G"), ("Nord", "5G"), ("Nord", "3G"), (None, "LTE")],
                               "region string, technology string")
    assert lines(quality.domain_violations(df, quality.NETWORK_DOMAINS)) == [
        ("region", "Nord", 2), ("technology", "3G", 1)]


def test_orphans(spark):
    fact = spark.createDataFrame([(1,), (1,), (7,), (7,), (8,)], "k int")
    dim = spark.createDataFrame([(1,), (2,)], "k int")
    assert lines(quality.orphan_report(fact, {"k": (dim, "k")})) == [("k", 3, 2)]


def test_csv_keeps_blanks_and_quotes(spark, tmp_path):
    rows = [account(i) for i in range(3)]
    rows[1]["PaymentMethod"] = 'Bank "transfer", (automatic) '
    raw = accounts(spark, rows)
    back = files.read_customer_csv(spark, files.write_csv(raw, str(tmp_path / "c")))
    assert lines(back) == lines(raw.select(*files.CUSTOMER_COLUMNS))
    assert back.where("TotalCharges = ' '").count() == 1


def test_network_csv_types_and_bad_rows(spark, tmp_path):
    rows = network_csv_rows()
    bad = list(rows[0])
    bad[4] = "fast"
    path = files.write_csv(network_raw(spark, [*rows, tuple(bad)]), str(tmp_path / "n"))
    kept = files.read_network_csv(spark, path, fail_fast=False)
    assert dict(kept.dtypes)["latency_ms"] == "double"
    # Parsed once and kept: only the corrupt-record column alone cannot be asked for.
    assert sum(r._corrupt_record is not None for r in kept.collect()) == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_network_csv(spark, path).collect()


def test_infer_result_types(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", "1.5", "x1"), ("b", "2", "2", "3")],
                               "name string, n string, r string, t string")
    back = files.infer_result_types(files.read_text_csv(spark, files.write_csv(df, str(tmp_path / "t"))))
    assert [t for _, t in back.dtypes] == ["string", "bigint", "double", "string"]


def test_staging_customer(spark):
    rows = [account(1, gender=" Male\t", MonthlyCharges=" 70.5 ", Churn="Yes "), account(0)]
    staged = {r.customerID: r for r in loading.stage_customer(accounts(spark, rows)).collect()}
    first, blank = staged["0001-ABC"], staged["0000-ABC"]
    assert (first.gender, first.monthly_charges, first.churn_flag) == ("Male", 70.5, 1)
    assert (blank.total_charges, blank.tenure, blank.tenure_band) == (0.0, 0, "0-12 months")


@pytest.mark.parametrize("change", [{"Churn": "Maybe"}, {"MonthlyCharges": "ten"}, {"tenure": "1.x"}])
def test_staging_fails_on_malformed_values(spark, change):
    with pytest.raises(Exception):
        loading.stage_customer(accounts(spark, [account(1, **change)])).collect()


def test_lenient_staging_gives_null(spark):
    rows = [account(1, Churn="Maybe", MonthlyCharges="ten", tenure="?")]
    row = loading.stage_customer(accounts(spark, rows), strict=False).first()
    assert (row.churn_flag, row.monthly_charges, row.tenure) == (None, None, None)


def test_blank_audit(spark):
    rows = [account(0), account(5, TotalCharges="  "), account(6)]
    row = loading.blank_audit(accounts(spark, rows)).first()
    assert (row.blank_total_charges, row.blank_with_tenure) == (2, 1)


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_and_totals_in_order(spark, parts):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit(2).cast("bigint").alias("v"))
    numbered = number_in_order(df.repartition(parts), ["k"], "n")
    assert numbered.where("n <> k + 1").count() == 0 and numbered.count() == 500
    before = totals_before(df.repartition(parts), ["k"], "v", "b")
    assert before.where("b <> 2 * k").count() == 0 and before.count() == 500


def test_customer_load_and_cube(spark, house):
    rows = [account(i, Churn="Yes" if i % 4 == 0 else "No",
                    Contract="Two year" if i % 2 else "Month-to-month") for i in range(40)]
    audit = loading.load_customer(house, accounts(spark, rows)).first()
    assert (audit.source_rows, audit.dim_customer_rows, audit.dim_plan_rows,
            audit.fact_customer_churn_rows, audit.rejected_rows) == (40, 40, 2, 40, 0)
    assert audit.blank_total_charges_cleaned == 1
    summary = CustomerCube(house.customer_star()).summary().first()
    assert (summary.total_customers, summary.churned_customers) == (40, 10)
    with pytest.raises(ValueError, match="already loaded"):
        loading.load_customer(house, accounts(spark, rows[:2]), reset=False)
    more = [account(i) for i in range(100, 105)]
    audit = loading.load_customer(house, accounts(spark, more), reset=False).first()
    assert (audit.dim_customer_rows, audit.dim_plan_rows, audit.fact_customer_churn_rows) == (45, 3, 45)
    keys = house.read("dim_customer").agg(F.count_distinct("customer_key"), F.max("customer_key")).first()
    assert tuple(keys) == (45, 45)
    audit = loading.load_customer(house, accounts(spark, more)).first()
    assert audit.fact_customer_churn_rows == 5


@pytest.mark.parametrize("change,message", [
    ({"customerID": "0001-ABC"}, "duplicate"),
    ({"Contract": "Weekly"}, "Contract in domain"),
    ({"MonthlyCharges": "-3"}, "monthly_charges >= 0"),
    ({"gender": None}, "gender not null"),
])
def test_customer_load_rejects(spark, house, change, message):
    with pytest.raises(ValueError, match=message):
        loading.load_customer(house, accounts(spark, [account(1), account(2, **change)]))
    assert not house.exists("fact_customer_churn")


def test_network_load_and_cube(spark, house):
    audit = loading.load_network(house, network_raw(spark)).first()
    assert (audit.source_rows, audit.dim_cell_rows, audit.dim_region_rows, audit.dim_tech_rows,
            audit.dim_time_rows, audit.fact_network_kpi_rows) == (12, 4, 3, 2, 3, 12)
    cube = NetworkCube(house.network_star())
    row = cube.summary().first()
    assert (row.total_observations, row.number_of_cells, row.number_of_regions,
            row.number_of_technologies) == (12, 4, 3, 2)
    assert [r.observation_count for r in cube.rollup("minute").collect()] == [4, 4, 4]
    assert cube.rollup("hour").first().time_bucket == "2026-08-03 14:00:00"
    assert [r.cell_id for r in cube.drilldown("North").collect()] == ["Cell_0000", "Cell_0002"]
    assert cube.drilldown("North").first().time_grouping == "2026-08-03 14:00:00 - 2026-08-03 14:02:00"
    assert len(cube.drilldown("North", "Cell_0002").collect()) == 3
    assert cube.dice(start_time="2026-08-03 14:01:00", region="North").first().observation_count == 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_times_are_not_looked_up(spark, house):
    """Questions about time read the fact's own column: no join with dim_time, filters at the scan."""
    loading.load_network(house, network_raw(spark))
    star = house.network_star()
    cube = NetworkCube(star)
    for df in (cube.drilldown("North"), cube.rollup("hour"), cube.slice("hour", 14), telemetry.cell_detail(star),
               telemetry.cell_telemetry(star, "Cell_0002"), telemetry.first_baselines(star), clusters.kpi_table(star)):
        assert "fact_network_kpi" in " ".join(df.inputFiles()) and "dim_time" not in " ".join(df.inputFiles())
    plan = plan_of(telemetry.cell_telemetry(star, "Cell_0002", "2026-08-03 14:01:00"))
    assert "GreaterThanOrEqual(timestamp,2026-08-03T14:01" in plan
    assert "PartitionFilters: [isnotnull(fact_date" in plan


def test_fact_without_times_looks_them_up(spark, house):
    """A fact that holds only keys gives the same answers by way of the time dimension."""
    loading.load_network(house, network_raw(spark))
    near = house.network_star()
    far = network_star(near.fact.drop("timestamp"), *[house.read(t) for t in (
        "dim_cell", "dim_region", "dim_network_tech", "dim_time")])
    for ask in (lambda s: NetworkCube(s).drilldown("North"), lambda s: NetworkCube(s).rollup("minute"),
                telemetry.cell_detail, telemetry.first_baselines):
        assert lines(ask(far)) == lines(ask(near))


def test_day_filter_prunes_files(spark, house):
    loading.load_network(house, network_raw(spark))
    cube = NetworkCube(house.network_star())
    plan = cube.slice("date", "2026-08-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fact_date" in plan
    assert cube.slice("date", "2026-08-03").first().observation_count == 12


@pytest.mark.parametrize("place,value", [(1, " Cell_0003"), (2, "Centre"), (6, "101"), (4, "-1")])
def test_network_load_rejects(spark, house, place, value):
    rows = network_csv_rows()
    bad = list(rows[0])
    bad[place] = value
    if place == 1:
        bad[0] = rows[-1][0]
    with pytest.raises(ValueError):
        loading.load_network(house, network_raw(spark, [*rows[1:], tuple(bad)]))


def test_appended_telemetry_is_not_doubled(spark, house):
    loading.load_network(house, network_raw(spark))
    with pytest.raises(ValueError, match="cell_id and timestamp values are already loaded"):
        loading.load_network(house, network_raw(spark), reset=False)
    more = [(r[0].replace("14:0", "15:0"), *r[1:]) for r in network_csv_rows()]
    for _ in range(2):
        audit = loading.load_network(house, network_raw(spark, network_csv_rows() + more), reset=False, on_known="skip").first()
    fact = house.read("fact_network_kpi")
    assert audit.fact_network_kpi_rows == 24 == fact.select("cell_key", "time_key").distinct().count()
    assert fact.select("network_kpi_key").distinct().count() == 24
    with pytest.raises(ValueError, match="on_known"):
        loading.load_network(house, network_raw(spark), reset=False, on_known="replace")


def test_customer_append_is_repeated_after_a_failure(spark, house, monkeypatch):
    loading.load_customer(house, accounts(spark, [account(i) for i in range(5)]))
    more = accounts(spark, [account(i, Contract="Two year") for i in range(10, 14)])
    with monkeypatch.context() as broken:
        def fail(*_):
            raise RuntimeError("lost")
        broken.setattr(loading, "_store_fact", fail)
        with pytest.raises(RuntimeError, match="lost"):
            loading.load_customer(house, more, reset=False)
    assert house.read("dim_customer").count() == 9 and house.read("fact_customer_churn").count() == 5
    audit = loading.load_customer(house, more, reset=False).first()
    assert (audit.dim_customer_rows, audit.dim_plan_rows, audit.fact_customer_churn_rows) == (9, 2, 9)
    assert house.read("dim_customer").select("customer_key").distinct().count() == 9


def test_quarantine_counts_and_keeps_bad_rows(spark, house):
    rows = [account(i) for i in range(1, 7)]
    rows += [account(1), account(1, MonthlyCharges="30.5"), account(2, Churn="Maybe"), account(20, TotalCharges="x"),
             account(21, Contract="Weekly", gender=None), account(21, Contract="Weekly", gender=None)]
    audit = loading.load_customer(house, accounts(spark, rows), quarantine=True).first()
    assert (audit.source_rows, audit.accepted_rows, audit.rejected_rows, audit.fact_customer_churn_rows) == (12, 6, 6, 6)
    bad = house.read("rejected_customer")
    assert bad.agg(F.sum("copies")).first()[0] == 6
    found = {(r.customerID, tuple(sorted(r.broken_rules))) for r in bad.collect()}
    assert found == {("0001-ABC", ("customerID unique",)), ("0002-ABC", ("churn_flag not null",)),
                     ("0020-ABC", ("total_charges not null",)), ("0021-ABC", ("Contract in domain", "gender not null"))}
    # Of an account's rows the least one is loaded, whatever their order.
    kept = house.read("fact_customer_churn").join(house.read("dim_customer"), "customer_key").where("customerID = '0001-ABC'")
    assert [r.monthly_charges for r in kept.collect()] == [20.15]


def test_quarantine_of_nothing_and_of_everything(spark, house):
    audit = loading.load_network(house, network_raw(spark), quarantine=True).first()
    assert (audit.rejected_rows, house.read("rejected_network").count()) == (0, 0)
    bad = [(*r[:6], "101", *r[7:]) for r in network_csv_rows()]
    audit = loading.load_network(house, network_raw(spark, bad), quarantine=True).first()
    assert (audit.source_rows, audit.accepted_rows, audit.rejected_rows) == (12, 0, 12)


def test_source_is_read_once(spark, house, tmp_path):
    path = str(tmp_path / "raw")
    network_raw(spark).repartition(3).write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    raw = spark.read.parquet(path)
    loading.load_network(house, raw.mapInArrow(counted, raw.schema))
    assert read.value == 12


def test_blank_charges_of_old_accounts_warn(spark, house):
    with pytest.warns(UserWarning, match="1 accounts with a tenure"):
        loading.load_customer(house, accounts(spark, [account(0), account(5, TotalCharges=" ")]))


def test_unresolved_keys_fail_the_write(spark, house):
    staged = spark.createDataFrame([("a",), ("b",)], "name string")
    dim = spark.createDataFrame([("a", 1)], "name string, key bigint")
    resolved = loading.resolve_keys(staged, {"key": (dim, {"name": "name"})})
    assert lines(loading.unresolved_keys(resolved, ["key"])) == [("key", 1)]
    with pytest.raises(Exception, match="unresolved key"):
        resolved.select(*loading.require_keys(["key"])).collect()


def test_reconciliation_shows_a_difference(spark):
    left = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    right = spark.createDataFrame([(1.0,), (2.5,)], "x double")
    row = loading.reconcile_totals(left, right, {"sum": (F.sum("x"), F.sum("x"))}).first()
    assert (row.source_value, row.warehouse_value, row.difference) == (3.0, 3.5, 0.5)
    counts = loading.reconcile_counts({"a": left, "b": right.where("x > 1")}).first()
    assert (counts.a_rows, counts.b_rows, counts.all_equal) == (2, 1, False)


def test_small_dimensions_are_resolved_first(spark, monkeypatch):
    """A large dimension's join does not carry the natural keys of the small ones."""
    staged = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", None, 3)], "who string, kind string, n int")
    people = spark.createDataFrame([(7, "a"), (8, "c")], "who_key bigint, name string")
    kinds = spark.createDataFrame([(1, "x"), (2, "y")], "kind_key bigint, kind_name string")
    monkeypatch.setattr(loading, "fits_broadcast", lambda side: "kind_key" in side.columns)
    got = loading.resolve_keys(staged, {"who_key": (people, {"who": "name"}), "kind_key": (kinds, {"kind": "kind_name"})})
    assert got.columns == ["who", "kind", "n", "who_key", "kind_key"]
    assert sorted(map(tuple, got.collect())) == [("a", "x", 1, 7, 1), ("b", "y", 2, None, 2), ("c", None, 3, 8, None)]


def test_resolving_joins_the_small_dimension_below_the_large(spark, monkeypatch, capsys):
    staged = spark.createDataFrame([("a", "x")], "who string, kind string")
    people = spark.createDataFrame([(7, "a")], "who_key bigint, name string")
    kinds = spark.createDataFrame([(1, "x")], "kind_key bigint, kind_name string")
    monkeypatch.setattr(loading, "fits_broadcast", lambda side: "kind_key" in side.columns)
    loading.resolve_keys(staged, {"who_key": (people, {"who": "name"}), "kind_key": (kinds, {"kind": "kind_name"})}).explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 2 and "__who" in joins[0] and "__kind" in joins[1]


def test_users_beyond_a_million_stay_cells_of_their_own(spark, tmp_path):
    """Ids that agree in their first six digits, with readings of the same time."""
    users = [7, 105_000, 1_050_000, 1_050_001, 105_000_000_001]
    events = spark.createDataFrame(
        [(i, datetime(2024, 1, 5, 10, 0), user, "view", 30.0, "{}") for i, user in enumerate(users)],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    house = Warehouse(spark, str(tmp_path / "house"))
    record = loading.load_network(house, raw_network(spark, str(tmp_path))).first()
    assert record["fact_network_kpi_rows"] == record["dim_cell_rows"] == len(users)
    assert {r["cell_id"] for r in house.read("dim_cell").collect()} == {
        "Cell_000007", "Cell_105000", "Cell_1050000", "Cell_1050001", "Cell_105000000001"}


def test_staged_rows_are_not_sorted_by_acceptance(spark, tmp_path, monkeypatch):
    """Staging keeps accepted and rejected rows in one table, and counts and splits them as before."""
    written = []
    monkeypatch.setattr(loading, "fresh_path", lambda s, name: written.append(str(tmp_path / name)) or written[-1])
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (-1, "b")], "v int, k string")
    found = loading._store_staged(rows, [quality.at_least("v", 0)], ["v"], "staged", True)
    assert sorted(r["v"] for r in found.rows.collect()) == [1, 2] and found.counts["source_rows"] == 3
    assert [(r["v"], r["broken_rules"], r["copies"]) for r in found.rejected.collect()] == [(-1, ["v >= 0"], 1)]
    assert not any("accepted=" in name for name in os.listdir(written[0]))
