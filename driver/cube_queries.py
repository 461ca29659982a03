"""Cube queries (SURVEY groups B, C) over the given tables, each with its SQL."""

from __future__ import annotations

from driver.sql import CHARGES, EVENTS, EVENT_DIGITS, OBS, churn_block, kpi_avgs
from driver.tables import customer_cube, event_cube, network_cube

QUERIES = {
    "b1_customer_summary": lambda s, d: customer_cube(s, d).summary(),
    "b2_customer_rollup_band": lambda s, d: customer_cube(s, d).rollup("tenure_band"),
    "b2b_customer_rollup_contract": lambda s, d: customer_cube(s, d).rollup("contract"),
    "b2b_customer_rollup_internet": lambda s, d: customer_cube(s, d).rollup("Internet Service"),
    "b2b_customer_rollup_payment": lambda s, d: customer_cube(s, d).rollup("payment-method"),
    "b3_customer_drilldown": lambda s, d: customer_cube(s, d).drilldown("0-12 months"),
    "b4_customer_slice_contract": lambda s, d: customer_cube(s, d).slice("contract", "1-URGENT"),
    "b4_customer_slice_band": lambda s, d: customer_cube(s, d).slice("tenure_band", "25-48 months"),
    "b4_customer_slice_size": lambda s, d: customer_cube(s, d).slice("size", "24"),
    "b5_customer_dice": lambda s, d: customer_cube(s, d).dice(
        contract="5-LOW", internet_service="F", tenure_band="0-12 months", churn_flag="Yes"),
    "b5_customer_dice_all": lambda s, d: customer_cube(s, d).dice(contract=None, brand=""),
    "b5_customer_dice_none_left": lambda s, d: customer_cube(s, d).dice(
        brand="Brand#1", payment_method="no such type"),
    "c1_network_summary": lambda s, d: network_cube(s, d).summary(),
    "c2_network_rollup_minute": lambda s, d: event_cube(s, d).rollup("minute"),
    "c2_network_rollup_hour": lambda s, d: event_cube(s, d).rollup("hour"),
    "c2_network_rollup_day": lambda s, d: network_cube(s, d).rollup("day"),
    "c2_network_rollup_month": lambda s, d: network_cube(s, d).rollup("month"),
    "c2b_network_rollup_region": lambda s, d: network_cube(s, d).rollup("region"),
    "c2b_network_rollup_technology": lambda s, d: network_cube(s, d).rollup("technology"),
    "c2c_network_rollup_week": lambda s, d: network_cube(s, d).rollup("week"),
    "c3_drilldown_region": lambda s, d: network_cube(s, d).drilldown("ASIA"),
    "c4_drilldown_cell": lambda s, d: network_cube(s, d).drilldown("EUROPE", EUROPE_CELL),
    "c5_slice_technology": lambda s, d: network_cube(s, d).slice("technology", "O"),
    "c5_slice_region": lambda s, d: network_cube(s, d).slice("region", "AFRICA"),
    "c5_slice_date": lambda s, d: network_cube(s, d).slice("date", "1998-06-15"),
    "c5_slice_year": lambda s, d: network_cube(s, d).slice("year", 1999),
    "c6_dice": lambda s, d: network_cube(s, d).dice(
        region="ASIA", technology="O", call_drop_rate_gt=2.0, latency_lt=150,
        throughput_gt="20.5", min_active_connections=100),
    "c6_dice_upper_bounds": lambda s, d: network_cube(s, d).dice(
        {"call drop rate lt": 5, "latency-gt": 40, "active_connections_gt": 300}),
    "c6_dice_all": lambda s, d: network_cube(s, d).dice(),
    "c6b_dice_time": lambda s, d: network_cube(s, d).dice(
        region="EUROPE", start_time="1997-01-01 00:00:00", end_time="1998-12-31 00:00:00"),
    "c7_high_drop": lambda s, d: network_cube(s, d).high_call_drop(8.0),
}

# A European supplier at sf0.01.
EUROPE_CELL = "Supplier#000000007"


def _customer(count, churned, retained, where="TRUE", by="", total=True, order=""):
    head = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return (f"WITH {CHARGES}\nSELECT {head}{churn_block(count, churned, retained, total)}\n"
            f"FROM accounts WHERE {where} {group} {order}")


def _subcube(where: str) -> str:
    return _customer("customer_count", "churned_count", "non_churned_count", where)


def _rollup(by: str) -> str:
    return _customer("customer_count", "churned_customers", "non_churned_customers", by=by)


def _network(where: str = "TRUE", by: str = "", group: str = "", count: bool = True) -> str:
    head = f"{by}, " if by else ""
    tail = f"GROUP BY {group}" if group else ""
    n = "count(*) AS observation_count, " if count else ""
    return f"WITH {OBS}\nSELECT {head}{n}{kpi_avgs()}\nFROM obs WHERE {where} {tail}"


def _bucket(level: str, fmt: str, cte: str, digits=None) -> str:
    means = kpi_avgs(digits) if digits else kpi_avgs()
    return (f"WITH {cte}\nSELECT strftime(date_trunc('{level}', ts), '{fmt}') AS time_bucket, "
            f"count(*) AS observation_count, {means}\nFROM obs GROUP BY 1")


SQL = {
    "b1_customer_summary": f"WITH {CHARGES} SELECT "
    + churn_block("total_customers", "churned_customers", "non_churned_customers") + " FROM charges",
    "b2_customer_rollup_band": _rollup("tenure_band"),
    "b2b_customer_rollup_contract": _rollup("contract"),
    "b2b_customer_rollup_internet": _rollup("internet_service"),
    "b2b_customer_rollup_payment": _rollup("payment_method"),
    "b3_customer_drilldown": _customer(
        "customer_count", "churned_customers", None, "tenure_band = '0-12 months'", "contract", False),
    "b4_customer_slice_contract": _subcube("contract = '1-URGENT'"),
    "b4_customer_slice_band": _subcube("tenure_band = '25-48 months'"),
    "b4_customer_slice_size": _subcube("size = 24"),
    "b5_customer_dice": _subcube("contract = '5-LOW' AND internet_service = 'F' "
                                 "AND tenure_band = '0-12 months' AND churn_flag = 1"),
    "b5_customer_dice_all": _subcube("TRUE"),
    "b5_customer_dice_none_left": _subcube("brand = 'Brand#1' AND payment_method = 'no such type'"),
    "c1_network_summary": f"""WITH {OBS}
SELECT count(*) AS total_observations, count(DISTINCT cell_id) AS number_of_cells,
  count(DISTINCT technology) AS number_of_technologies, count(DISTINCT region) AS number_of_regions,
  {kpi_avgs()} FROM obs""",
    "c2_network_rollup_minute": _bucket("minute", "%Y-%m-%d %H:%M:%S", EVENTS, EVENT_DIGITS),
    "c2_network_rollup_hour": _bucket("hour", "%Y-%m-%d %H:%M:%S", EVENTS, EVENT_DIGITS),
    "c2_network_rollup_day": _bucket("day", "%Y-%m-%d", OBS),
    "c2_network_rollup_month": _bucket("month", "%Y-%m", OBS),
    "c2b_network_rollup_region": _network(by="region", group="region"),
    "c2b_network_rollup_technology": _network(by="technology", group="technology"),
    "c2c_network_rollup_week": _bucket("week", "%Y-%m-%d", OBS),
    "c3_drilldown_region": _network(
        "region = 'ASIA'",
        "region, cell_id, technology, strftime(min(ts), '%Y-%m-%d %H:%M:%S') || ' - ' || "
        "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS time_grouping",
        "region, cell_id, technology", count=False),
    "c4_drilldown_cell": _network(
        f"region = 'EUROPE' AND cell_id = '{EUROPE_CELL}'",
        "region, cell_id, technology, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_grouping",
        "region, cell_id, technology, ts", count=False),
    "c5_slice_technology": _network("technology = 'O'"),
    "c5_slice_region": _network("region = 'AFRICA'"),
    "c5_slice_date": _network("strftime(ts, '%Y-%m-%d') = '1998-06-15'"),
    "c5_slice_year": _network("year(ts) = 1999"),
    "c6_dice": _network("region = 'ASIA' AND technology = 'O' AND call_drop_rate_pct > 2.0 "
                        "AND latency_ms < 150 AND throughput_mbps > 20.5 AND active_connections >= 100"),
    "c6_dice_upper_bounds": _network("call_drop_rate_pct < 5 AND latency_ms > 40 "
                                     "AND active_connections >= 300"),
    "c6_dice_all": _network(),
    "c6b_dice_time": _network("region = 'EUROPE' AND ts >= TIMESTAMP '1997-01-01 00:00:00' "
                              "AND ts <= TIMESTAMP '1998-12-31 00:00:00'"),
    "c7_high_drop": f"""WITH {OBS}
SELECT region, cell_id, technology, count(*) AS observation_count,
  {kpi_avgs(kpis=("call_drop_rate_pct", "latency_ms", "throughput_mbps", "active_connections"))}
FROM obs WHERE call_drop_rate_pct > 8.0 GROUP BY region, cell_id, technology""",
}
