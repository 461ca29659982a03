"""The same cubes over the two loaded marts, with their own dimension tables and domains."""

from __future__ import annotations

from driver.raw import (
    KPI_DIGITS,
    MONEY_DIGITS,
    STAGED_CUSTOMER_SQL,
    STAGED_NETWORK_SQL,
    raw_customer,
    raw_network,
    warehouse,
)
from driver.sql import KPIS, avg, kpi_avgs, rnd
from starcell.operators import loading, telemetry
from starcell.operators.cube import CustomerCube, NetworkCube
from starcell.session import fresh_path
from starcell.sources.warehouse import Warehouse

SIX = KPI_DIGITS


def customers(s, d) -> CustomerCube:
    return CustomerCube(warehouse(s, d).customer_star(), MONEY_DIGITS)


def network(s, d) -> NetworkCube:
    return NetworkCube(warehouse(s, d).network_star(), SIX)


def kept_up_days(s, d) -> NetworkCube:
    """Telemetry in three loads, the last of which brings what is known already: answered by what the loads kept up."""
    house = Warehouse(s, fresh_path(s, "kept"))
    raw = raw_network(s, d)
    for test, reset in (("timestamp < '2024-01-11'", True), ("timestamp >= '2024-01-11'", False), ("true", False)):
        loading.load_network(house, raw.where(test), reset, on_known="skip", rollup_digits=KPI_DIGITS)
    return NetworkCube(house.network_star(), KPI_DIGITS)


def kept_up_profiles(s, d) -> CustomerCube:
    """Accounts in two loads, answered by the profiles that the loads kept up."""
    house = Warehouse(s, fresh_path(s, "kept"))
    raw = raw_customer(s, d)
    for test, reset in (("gender = ' Male'", True), ("gender <> ' Male'", False)):
        loading.load_customer(house, raw.where(test), reset, rollup_digits=MONEY_DIGITS)
    return CustomerCube(house.customer_star(), MONEY_DIGITS)


QUERIES = {
    "b2_kept_rollup_band": lambda s, d: kept_up_profiles(s, d).rollup(),
    "c2_kept_rollup_day": lambda s, d: kept_up_days(s, d).rollup("day"),
    "b1_mart_summary": lambda s, d: customers(s, d).summary(),
    "b2_mart_rollup_band": lambda s, d: customers(s, d).rollup(),
    "b2b_mart_rollup_contract": lambda s, d: customers(s, d).rollup("contract"),
    "b3_mart_drilldown": lambda s, d: customers(s, d).drilldown("13-24 months"),
    "b4_mart_slice_payment": lambda s, d: customers(s, d).slice("payment method", "Electronic check"),
    "b4_mart_slice_senior": lambda s, d: customers(s, d).slice("senior_citizen", "1"),
    "b5_mart_dice": lambda s, d: customers(s, d).dice(
        contract="Month-to-month", internet_service="Fiber optic", tenure_band="49-72 months",
        paperless_billing="Yes", gender="Female"),
    "c1_mart_summary": lambda s, d: network(s, d).summary(),
    "c2_mart_rollup_hour": lambda s, d: network(s, d).rollup("hour"),
    "c2_mart_rollup_month": lambda s, d: network(s, d).rollup("month"),
    "c2b_mart_rollup_technology": lambda s, d: network(s, d).rollup("technology"),
    "c3_mart_drilldown": lambda s, d: network(s, d).drilldown("North"),
    "c4_mart_drilldown_cell": lambda s, d: network(s, d).drilldown("North", "Cell_000007"),
    "c5_mart_slice_hour": lambda s, d: network(s, d).slice("hour", 14),
    "c5_mart_slice_date": lambda s, d: network(s, d).slice("date", "2024-01-09"),
    "c6_mart_dice": lambda s, d: network(s, d).dice(
        region="North", technology="5G", call_drop_rate_gt=2.0),
    "c6b_mart_dice_time": lambda s, d: network(s, d).dice(
        start_time="2024-01-05 12:00:00", end_time="2024-01-20 00:00:00", technology="LTE"),
    "c7_mart_high_drop": lambda s, d: network(s, d).high_call_drop(),
    "d2_mart_cell_detail": lambda s, d: telemetry.cell_detail(network(s, d).star),
    "d4_mart_cell_summary": lambda s, d: telemetry.cell_summary_long(
        network(s, d).star, SIX, "Cell_000007"),
    "d6_mart_first_baselines": lambda s, d: telemetry.first_baselines(network(s, d).star),
}


def _block(count: str, churned: str, retained: str | None, total: bool = True) -> str:
    cols = [f"count(*) AS {count}",
            f"CAST(coalesce(sum(churn_flag), 0) AS BIGINT) AS {churned}"]
    if retained:
        cols.append(f"count(*) FILTER (churn_flag = 0) AS {retained}")
    cols += [f"{avg('churn_flag', 0, factor=' * 100.0::DOUBLE')} AS churn_rate_pct",
             f"{avg('monthly_charges', 6)} AS avg_monthly_charges"]
    if total:
        cols.append(f"{avg('total_charges', 6)} AS avg_total_charges")
    return ", ".join(cols)


def _c(block: str, where: str = "TRUE", by: str = "") -> str:
    head, tail = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"WITH {STAGED_CUSTOMER_SQL} SELECT {head}{block} FROM staged WHERE {where} {tail}"


def _n(select: str, where: str = "TRUE", group: str = "") -> str:
    tail = f"GROUP BY {group}" if group else ""
    return f"WITH {STAGED_NETWORK_SQL} SELECT {select} FROM staged WHERE {where} {tail}"


_SUB = _block("customer_count", "churned_count", "non_churned_count")
_ROLL = _block("customer_count", "churned_customers", "non_churned_customers")
_OBS = f"count(*) AS observation_count, {kpi_avgs(SIX)}"
_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_PLACES = {"latency_ms": 2, "throughput_mbps": 2, "packet_loss_pct": 3, "call_drop_rate_pct": 3,
           "signal_strength_dbm": 2, "handover_success_pct": 2, "active_connections": 0}

SQL = {
    "b2_kept_rollup_band": _c(_ROLL, by="tenure_band"),
    "c2_kept_rollup_day": _n(f"strftime(timestamp, '%Y-%m-%d') AS time_bucket, {_OBS}", group="1"),
    "b1_mart_summary": _c(_block("total_customers", "churned_customers", "non_churned_customers")),
    "b2_mart_rollup_band": _c(_ROLL, by="tenure_band"),
    "b2b_mart_rollup_contract": _c(_ROLL, by="Contract").replace("SELECT Contract,", "SELECT Contract AS contract,"),
    "b3_mart_drilldown": _c(_block("customer_count", "churned_customers", None, False),
                            "tenure_band = '13-24 months'", "Contract").replace(
                                "SELECT Contract,", "SELECT Contract AS contract,"),
    "b4_mart_slice_payment": _c(_SUB, "PaymentMethod = 'Electronic check'"),
    "b4_mart_slice_senior": _c(_SUB, "SeniorCitizen = 1"),
    "b5_mart_dice": _c(_SUB, "Contract = 'Month-to-month' AND InternetService = 'Fiber optic' AND "
                       "tenure_band = '49-72 months' AND PaperlessBilling = 'Yes' AND gender = 'Female'"),
    "c1_mart_summary": _n("count(*) AS total_observations, count(DISTINCT cell_id) AS number_of_cells, "
                          "count(DISTINCT region) AS number_of_regions, count(DISTINCT technology) AS "
                          f"number_of_technologies, {kpi_avgs(SIX)}"),
    "c2_mart_rollup_hour": _n(f"{_TEXT.format('date_trunc(' + repr('hour') + ', timestamp)')} AS time_bucket, {_OBS}",
                              group="1"),
    "c2_mart_rollup_month": _n(f"strftime(timestamp, '%Y-%m') AS time_bucket, {_OBS}", group="1"),
    "c2b_mart_rollup_technology": _n(f"technology, {_OBS}", group="1"),
    "c3_mart_drilldown": _n(f"region, cell_id, technology, {_TEXT.format('min(timestamp)')} || ' - ' || "
                            f"{_TEXT.format('max(timestamp)')} AS time_grouping, {kpi_avgs(SIX)}",
                            "region = 'North'", "region, cell_id, technology"),
    "c4_mart_drilldown_cell": _n(f"region, cell_id, technology, {_TEXT.format('timestamp')} AS time_grouping, "
                                 f"{kpi_avgs(SIX)}", "region = 'North' AND cell_id = 'Cell_000007'",
                                 "region, cell_id, technology, timestamp"),
    "c5_mart_slice_hour": _n(_OBS, "hour(timestamp) = 14"),
    "c5_mart_slice_date": _n(_OBS, "strftime(timestamp, '%Y-%m-%d') = '2024-01-09'"),
    "c6_mart_dice": _n(_OBS, "region = 'North' AND technology = '5G' AND call_drop_rate_pct > 2.0"),
    "c6b_mart_dice_time": _n(_OBS, "timestamp >= TIMESTAMP '2024-01-05 12:00:00' AND "
                             "timestamp <= TIMESTAMP '2024-01-20 00:00:00' AND technology = 'LTE'"),
    "c7_mart_high_drop": _n(
        "region, cell_id, technology, count(*) AS observation_count, "
        + kpi_avgs(SIX, ("call_drop_rate_pct", "latency_ms", "throughput_mbps", "active_connections")),
        "call_drop_rate_pct > 2.0", "region, cell_id, technology"),
    "d2_mart_cell_detail": _n("cell_id, region, technology, count(*) AS available_observation_count, "
                              f"{_TEXT.format('min(timestamp)')} AS start_time, "
                              f"{_TEXT.format('max(timestamp)')} AS end_time", group="ALL"),
    "d4_mart_cell_summary": " UNION ALL ".join(
        "SELECT * FROM (" + _n(
            f"cell_id, region, technology, count(*) AS observation_count, '{k}' AS metric_key, "
            f"{rnd(f'min({k}::DOUBLE)', p)} AS min, {rnd(f'max({k}::DOUBLE)', p)} AS max, "
            f"{avg(k, 6, p or 1, empty=None)} AS avg", "cell_id = 'Cell_000007'", "cell_id, region, technology") + ")"
        for k, p in _PLACES.items()),
    "d6_mart_first_baselines": f"""WITH {STAGED_NETWORK_SQL}, ranked AS (SELECT *, row_number() OVER (
    PARTITION BY cell_id ORDER BY timestamp) AS place FROM staged)
SELECT cell_id, region, technology, {_TEXT.format('timestamp')} AS timestamp,
  {", ".join(f"{rnd(k, p)} AS {k}" for k, p in _PLACES.items() if p)}, active_connections
FROM ranked WHERE place = 1""",
}
