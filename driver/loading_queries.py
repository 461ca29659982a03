"""Source, quality and load queries (SURVEY group A), with SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver.raw import (BAND, RAW_CUSTOMER_SQL, RAW_NETWORK, STAGED_CUSTOMER_SQL,
                        STAGED_NETWORK_SQL, raw_customer, raw_network, raw_network_sql, warehouse)
from driver.tables import table
from starcell.functions.labels import band_label
from starcell.functions.numeric import exact_mean, exact_sum, from_units
from starcell.functions.timeparts import calendar_parts, stamp_text
from starcell.operators import loading, quality
from starcell.plans.marts import KPIS, PLAN_COLUMNS
from starcell.plans.ordering import number_in_order
from starcell.session import fresh_path
from starcell.sources import files
from starcell.sources.warehouse import Warehouse

NETWORK_TEXT = ("cell_id", "region", "technology")
LINE_DOMAINS = {"l_returnflag": ("A", "N"), "l_linestatus": ("F",)}


def csv_customer(s, d):
    """Write the raw accounts as CSV and scan them as text."""
    path = files.write_csv(raw_customer(s, d), fresh_path(s, "customer-csv"))
    return files.read_customer_csv(s, path)


def csv_network(s, d):
    path = files.write_csv(raw_network(s, d), fresh_path(s, "network-csv"))
    return files.read_network_csv(s, path)


def line_rules():
    """Range, domain and NOT NULL rules that the given lineitem partly breaks."""
    return [quality.required("l_orderkey"), quality.within("l_quantity", 1, 45),
            quality.within("l_discount", 0, 0.08), quality.at_least("l_extendedprice", 1500),
            quality.one_of("l_returnflag", ("A", "N")), quality.at_least("l_tax", 0)]


def quarantine(s, d):
    """Rejected rows counted by the combination of rules they break."""
    _, rejected = quality.split_by_rules(table(s, d, "lineitem"), line_rules())
    broken = F.array_join(F.array_sort("broken_rules"), "; ")
    return rejected.groupBy(broken.alias("broken_rules")).agg(F.count(F.lit(1)).alias("row_count"))


def sparse_orders(s, d):
    """orders with NULL where a value is unusual, to give the null check work."""
    return table(s, d, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") > 1000 * 100, F.col("o_totalprice")).alias("o_totalprice"),
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"))


def staged_customer(s, d):
    return loading.stage_customer(raw_customer(s, d))


def staged_network(s, d):
    rows = loading.stage_network(raw_network(s, d))
    return rows.withColumn("timestamp", stamp_text("timestamp"))


def plan_dimension(s, d):
    plan = list(PLAN_COLUMNS)
    return loading.build_dimension(staged_customer(s, d), plan, plan, "plan_key")


def customer_dimension(s, d):
    """Numbered by sorted parts, as a large dimension is."""
    who = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure"]
    return number_in_order(staged_customer(s, d).select(*who), ["customerID"], "customer_key")


def simple_dimensions(s, d):
    """Cell, region and technology members with their keys, in one list."""
    staged = loading.stage_network(raw_network(s, d))
    lists = [loading.build_dimension(staged, [F.col(c).alias("member")], ["member"], "key").select(
        F.lit(c).alias("dimension"), "key", "member") for c in NETWORK_TEXT]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


def time_dimension(s, d):
    staged = loading.stage_network(raw_network(s, d))
    return loading.build_dimension(staged, loading.TIME_COLUMNS, ["timestamp"], "time_key")


def unresolved(s, d):
    """Order lines looked up in a dimension of high-priority orders: some keys stay NULL."""
    orders = table(s, d, "orders").where("o_orderpriority <> '3-MEDIUM'").select(
        "o_orderkey", F.col("o_orderkey").alias("order_key"))
    parts = table(s, d, "part").where("p_size <= 40").select(
        "p_partkey", F.col("p_partkey").alias("part_key"))
    rows = loading.resolve_keys(table(s, d, "lineitem"), {
        "order_key": (orders, {"l_orderkey": "o_orderkey"}),
        "part_key": (parts, {"l_partkey": "p_partkey"}),
    })
    return loading.unresolved_keys(rows, ["order_key", "part_key"])


def orphans(s, d):
    return quality.orphan_report(table(s, d, "lineitem"), {
        "l_orderkey": (table(s, d, "orders").where("o_orderpriority <> '3-MEDIUM'"), "o_orderkey"),
        "l_partkey": (table(s, d, "part").where("p_size <= 40"), "p_partkey"),
        "l_suppkey": (table(s, d, "supplier"), "s_suppkey"),
    })


def customer_fact(s, d):
    """The stored fact with its keys turned back into names."""
    house = warehouse(s, d)
    fact, who, plan = (house.read(t) for t in ("fact_customer_churn", "dim_customer", "dim_plan"))
    return fact.join(who, "customer_key").join(plan, "plan_key").select(
        "customerID", "customer_key", "plan_key", "Contract", "PaymentMethod", "tenure",
        "monthly_charges", "total_charges", "churn_flag", "customer_count")


def network_fact(s, d):
    house = warehouse(s, d)
    # The time comes from its dimension here, so that its keys are tested too.
    rows = house.read("fact_network_kpi").drop("timestamp")
    for dim, key in (("dim_cell", "cell_key"), ("dim_region", "region_key"),
                     ("dim_network_tech", "technology_key"), ("dim_time", "time_key")):
        rows = rows.join(house.read(dim), key)
    return rows.select("cell_key", "region_key", "technology_key", "time_key", "cell_id",
                       F.col("region_name").alias("region"), F.col("technology_name").alias("technology"),
                       "timestamp", F.col("fact_date").cast("string").alias("fact_date"), "quarter",
                       *KPIS, "reading_count")


def append_twice(s, d):
    """Events of the first half of the month loaded, the rest appended: rows per table."""
    house = Warehouse(s, fresh_path(s, "append"))
    raw = raw_network(s, d)
    loading.load_network(house, raw.where("timestamp < '2024-01-16'"))
    loading.load_network(house, raw.where("timestamp >= '2024-01-16'"), reset=False)
    ids = house.read("fact_network_kpi").agg(
        F.lit("distinct fact ids").alias("table_name"), F.count_distinct("network_kpi_key").alias("row_count"))
    for name in ("dim_cell", "dim_region", "dim_network_tech", "dim_time", "fact_network_kpi"):
        ids = ids.unionByName(house.read(name).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")))
    return ids


# What spoils a raw row, as SQL that both sides run on the raw text; clicks come twice.
SPOILED = {
    "latency_ms": "CASE WHEN latency_ms LIKE '%7' THEN 'n/a' ELSE latency_ms END",
    "region": "CASE WHEN cell_id LIKE '%13 ' THEN 'Nowhere' ELSE region END",
    "handover_success_pct": "CASE WHEN cell_id LIKE '%5 ' THEN '100.5' ELSE handover_success_pct END",
}


def spoiled_network(s, d):
    raw = raw_network(s, d)
    raw = raw.select(*[F.expr(SPOILED.get(c, c)).alias(c) for c in raw.columns])
    return raw.unionByName(raw.where("region = 'North'"))


def quarantined_load(s, d):
    return loading.load_network(Warehouse(s, fresh_path(s, "quarantine")), spoiled_network(s, d), quarantine=True)


def rejected_rules(s, d):
    """How many rows each rule set apart, read from the quarantine table."""
    house = Warehouse(s, fresh_path(s, "quarantine"))
    loading.load_network(house, spoiled_network(s, d), quarantine=True)
    rows = house.read("rejected_network").select(F.explode("broken_rules").alias("rule"), "copies")
    return rows.groupBy("rule").agg(F.sum("copies").alias("row_count"))


def append_again(s, d):
    """The first half of the month, then all of it twice, with what is known skipped: rows and distinct keys."""
    house = Warehouse(s, fresh_path(s, "again"))
    raw = raw_network(s, d)
    loading.load_network(house, raw.where("timestamp < '2024-01-16'"))
    for _ in range(2):
        loading.load_network(house, raw, reset=False, on_known="skip")
    return house.read("fact_network_kpi").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("cell_key", "time_key").alias("natural_keys"),
        F.count_distinct("network_kpi_key").alias("fact_ids"))


def reset_twice(s, d):
    """A rebuild replaces what was there."""
    house = Warehouse(s, fresh_path(s, "reset"))
    loading.load_customer(house, raw_customer(s, d).where("Contract = 'One year'"))
    return loading.load_customer(house, raw_customer(s, d))


def count_reconciliation(s, d):
    house = warehouse(s, d)
    return loading.reconcile_counts({
        "source": raw_customer(s, d), "dimension": house.read("dim_customer"),
        "fact": house.read("fact_customer_churn")})


def _mean(value, digits):
    return exact_mean(exact_sum(value, digits), F.count(value), digits)


def _sum(value, digits):
    return from_units(exact_sum(value, digits), digits)


def customer_reconciliation(s, d):
    monthly, total = (loading.lenient_number(F.col(c)) for c in ("MonthlyCharges", "TotalCharges"))
    total = F.coalesce(total, F.lit(0.0))
    churn = F.btrim("Churn")
    col = F.col
    return loading.reconcile_totals(raw_customer(s, d), warehouse(s, d).read("fact_customer_churn"), {
        "total_customers": (F.count(F.lit(1)), F.count(F.lit(1))),
        "churned_customers": (F.count_if(churn == "Yes"), F.sum("churn_flag")),
        "retained_customers": (F.count_if(churn == "No"), F.count_if(col("churn_flag") == 0)),
        "avg_monthly_charges": (_mean(monthly, 2), _mean(col("monthly_charges"), 2)),
        "sum_total_charges": (_sum(total, 2), _sum(col("total_charges"), 2)),
    })


def network_reconciliation(s, d):
    digits = {k: places for k, (places, _) in KPIS.items()}
    kpis = ("latency_ms", "throughput_mbps", "packet_loss_pct", "call_drop_rate_pct", "active_connections")
    metrics = {f"avg_{k}": (_mean(loading.lenient_number(F.col(k)), digits[k]), _mean(F.col(k), digits[k]))
               for k in kpis}
    return loading.reconcile_totals(raw_network(s, d), warehouse(s, d).read("fact_network_kpi"), metrics)


def result_round_trip(s, d):
    """A report stored as CSV, read back with its schema."""
    report = quality.rule_report(table(s, d, "lineitem"), line_rules())
    path = files.write_csv(report, fresh_path(s, "report-csv"))
    return files.read_result_csv(s, path, "rule string, violation_count bigint")


def json_round_trip(s, d):
    report = quality.null_counts(sparse_orders(s, d))
    path = files.write_json(report, fresh_path(s, "report-json"))
    return files.read_result_json(s, path, "column_name string, null_count bigint")


def inferred_result(s, d):
    """A report stored as CSV, read back with types found from its values."""
    rows = table(s, d, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("parts"), (F.max("p_retailprice") + 0.25).alias("dearest"))
    return files.infer_result_types(files.read_text_csv(s, files.write_csv(rows, fresh_path(s, "inferred"))))


QUERIES = {
    "a1_scan_customer_csv": csv_customer,
    "a2_scan_network_csv": csv_network,
    "a4_null_counts": lambda s, d: quality.null_counts(sparse_orders(s, d)),
    "a5_duplicates_single": lambda s, d: quality.surplus_duplicates(table(s, d, "lineitem"), ["l_orderkey"]),
    "a5_duplicates_composite": lambda s, d: quality.surplus_duplicates(
        raw_network(s, d, "minute"), ["cell_id", "timestamp"]),
    "a5b_duplicate_keys": lambda s, d: quality.duplicate_keys(
        table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "a6_domain_violations": lambda s, d: quality.domain_violations(table(s, d, "lineitem"), LINE_DOMAINS),
    "a7_rule_report": lambda s, d: quality.rule_report(table(s, d, "lineitem"), line_rules()),
    "a7_quarantine": quarantine,
    "a8_trimmed_network": lambda s, d: loading.trim_text(raw_network(s, d)),
    "a9_blank_audit": lambda s, d: loading.blank_audit(raw_customer(s, d)),
    "a11_staged_customer": staged_customer,
    "a12_tenure_bands": lambda s, d: table(s, d, "part").groupBy(
        band_label("p_size").alias("tenure_band")).agg(F.count(F.lit(1)).alias("row_count")),
    "a13_calendar_parts": lambda s, d: table(s, d, "events").select(
        "event_id", *[c.alias(n) for n, c in calendar_parts("ts").items()]),
    "a14_simple_dimensions": simple_dimensions,
    "a14_time_dimension": time_dimension,
    "a15_plan_dimension": plan_dimension,
    "a16_customer_dimension": customer_dimension,
    "a17_unresolved_keys": unresolved,
    "a18_customer_fact": customer_fact,
    "a18_network_fact": network_fact,
    "a18b_append": append_twice,
    "a18b_append_again": append_again,
    "a18b_reset": reset_twice,
    "a19_orphans": orphans,
    "a20_row_counts": count_reconciliation,
    "a21_customer_totals": customer_reconciliation,
    "a21_network_totals": network_reconciliation,
    "a22_network_audit": lambda s, d: loading.load_network(
        Warehouse(s, fresh_path(s, "audit")), raw_network(s, d)),
    "a22_quarantined_load": quarantined_load,
    "a22_rejected_rules": rejected_rules,
    "a23_csv_result": result_round_trip,
    "a23_json_result": json_round_trip,
    "a24_inferred_result": inferred_result,
}

_RULES = {
    "l_orderkey not null": "l_orderkey IS NULL",
    "l_quantity in [1, 45]": "NOT (l_quantity BETWEEN 1 AND 45)",
    "l_discount in [0, 0.08]": "NOT (l_discount BETWEEN 0 AND 0.08::DOUBLE)",
    "l_extendedprice >= 1500": "l_extendedprice < 1500",
    "l_returnflag in domain": "l_returnflag NOT IN ('A', 'N')",
    "l_tax >= 0": "l_tax < 0",
}
_RULE_REPORT = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER ({t}) AS violation_count FROM lineitem" for n, t in _RULES.items())
_NULLS = ("WITH sparse AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, "
          "CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS o_totalprice, "
          "nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders) " + " UNION ALL ".join(
              f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count FROM sparse"
              for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")))
_PLAN = ", ".join(PLAN_COLUMNS)
_PLANS = f"plans AS (SELECT row_number() OVER (ORDER BY {_PLAN}) AS plan_key, * FROM (SELECT DISTINCT {_PLAN} FROM staged))"
_DIMS = ", ".join(
    f"d_{c} AS (SELECT row_number() OVER (ORDER BY {c}) AS k, {c} AS m FROM (SELECT DISTINCT {c} FROM staged))"
    for c in (*NETWORK_TEXT, "timestamp"))
_PARTS = ("strftime({0}, '%Y-%m-%d') AS date, CAST(hour({0}) AS INTEGER) AS hour, CAST(minute({0}) AS INTEGER) "
          "AS minute, CAST(day({0}) AS INTEGER) AS day, CAST(month({0}) AS INTEGER) AS month, "
          "CAST(quarter({0}) AS INTEGER) AS quarter, CAST(year({0}) AS INTEGER) AS year")
_CUSTOMER_AUDIT = f"""WITH {STAGED_CUSTOMER_SQL}, {_PLANS}
SELECT count(*) AS source_rows, count(*) AS staging_rows, count(*) AS accepted_rows, 0::BIGINT AS rejected_rows,
  (SELECT count(*) FROM raw WHERE trim(TotalCharges) = '') AS blank_total_charges_cleaned,
  count(DISTINCT customerID) AS dim_customer_rows, (SELECT count(*) FROM plans) AS dim_plan_rows,
  count(*) AS fact_customer_churn_rows FROM staged"""


def _exact(value: str, digits: int) -> str:
    return f"sum(CAST(round(({value}) * {10**digits}.0::DOUBLE) AS BIGINT))::DOUBLE"


def _recon(pairs: dict) -> str:
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, ({v})::DOUBLE AS source_value, ({v})::DOUBLE AS "
                              f"warehouse_value, 0.0::DOUBLE AS difference FROM staged" for m, v in pairs.items())
    return rows

# Spoiled rows as the loader stages them, with the rules they break, and one per key of the good ones.
_SPOILED = f"""WITH {raw_network_sql()},
once AS (SELECT raw.* REPLACE ({", ".join(f"{e} AS {c}" for c, e in SPOILED.items())}) FROM raw),
twice AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE region = 'North'),
staged AS (SELECT trim(cell_id) AS cell_id, trim(region) AS region, trim(technology) AS technology, timestamp,
  latency_ms = 'n/a' AS no_latency, trim(region) = 'Nowhere' AS no_region, handover_success_pct = '100.5' AS no_handover FROM twice),
good AS (SELECT * FROM staged WHERE NOT (no_latency OR no_region OR no_handover)),
kept AS (SELECT DISTINCT cell_id, region, technology, timestamp FROM good)"""


SQL = {
    "a1_scan_customer_csv": f"WITH {RAW_CUSTOMER_SQL} SELECT * FROM raw",
    "a2_scan_network_csv": f"WITH {STAGED_NETWORK_SQL}"
                           "SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, "
                           "* EXCLUDE (timestamp) FROM staged",
    "a4_null_counts": _NULLS,
    "a5_duplicates_single": "SELECT count(*) - count(DISTINCT l_orderkey) AS duplicate_count FROM lineitem",
    "a5_duplicates_composite": f"WITH {raw_network_sql('minute')} SELECT count(*) - "
                               "count(DISTINCT (cell_id, timestamp)) AS duplicate_count FROM raw",
    "a5b_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem "
                          "GROUP BY ALL HAVING count(*) > 1",
    "a6_domain_violations": "SELECT 'l_returnflag' AS column_name, l_returnflag AS value, count(*) AS row_count "
                            "FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY ALL UNION ALL "
                            "SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem "
                            "WHERE l_linestatus NOT IN ('F') GROUP BY ALL",
    "a7_rule_report": _RULE_REPORT,
    "a7_quarantine": "WITH marked AS (SELECT list_sort(list_filter(["
                     + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _RULES.items())
                     + "], lambda x: x IS NOT NULL)) AS b FROM lineitem) SELECT array_to_string(b, '; ') AS broken_rules, "
                     "count(*) AS row_count FROM marked WHERE len(b) > 0 GROUP BY ALL",
    "a8_trimmed_network": f"WITH {raw_network_sql()} SELECT timestamp, "
                          + ", ".join(f"trim({c}) AS {c}" for c in RAW_NETWORK) + " FROM raw",
    "a9_blank_audit": f"WITH {RAW_CUSTOMER_SQL} SELECT count(*) AS blank_total_charges, "
                      "count(*) FILTER (trim(tenure) <> '0') AS blank_with_tenure FROM raw WHERE trim(TotalCharges) = ''",
    "a11_staged_customer": f"WITH {STAGED_CUSTOMER_SQL} SELECT * FROM staged",
    "a12_tenure_bands": f"SELECT {BAND.replace('tenure', 'p_size')} AS tenure_band, count(*) AS row_count "
                        "FROM part GROUP BY 1",
    "a13_calendar_parts": f"SELECT event_id, {_PARTS.format('ts')} FROM events",
    "a14_simple_dimensions": f"WITH {STAGED_NETWORK_SQL}, {_DIMS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, k AS key, m AS member FROM d_{c}" for c in NETWORK_TEXT),
    "a14_time_dimension": f"WITH {STAGED_NETWORK_SQL}, {_DIMS} SELECT k AS time_key, m AS timestamp, "
                          f"{_PARTS.format('m')} FROM d_timestamp",
    "a15_plan_dimension": f"WITH {STAGED_CUSTOMER_SQL}, {_PLANS} SELECT * FROM plans",
    "a16_customer_dimension": f"WITH {STAGED_CUSTOMER_SQL} SELECT row_number() OVER (ORDER BY customerID) AS "
                              "customer_key, customerID, gender, SeniorCitizen, Partner, Dependents, tenure FROM staged",
    "a17_unresolved_keys": "SELECT 'order_key' AS column_name, count(*) AS null_count FROM lineitem WHERE l_orderkey "
                           "NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '3-MEDIUM') UNION ALL "
                           "SELECT 'part_key', count(*) FROM lineitem WHERE l_partkey NOT IN "
                           "(SELECT p_partkey FROM part WHERE p_size <= 40)",
    "a18_customer_fact": f"WITH {STAGED_CUSTOMER_SQL}, {_PLANS} SELECT customerID, row_number() OVER (ORDER BY "
                         "customerID) AS customer_key, plan_key, Contract, PaymentMethod, tenure, monthly_charges, "
                         "total_charges, churn_flag, 1 AS customer_count FROM staged JOIN plans USING "
                         f"({_PLAN})",
    "a18_network_fact": f"WITH {STAGED_NETWORK_SQL}, {_DIMS} SELECT c.k AS cell_key, r.k AS region_key, "
                        "t.k AS technology_key, z.k AS time_key, cell_id, region, technology, timestamp, "
                        "strftime(timestamp, '%Y-%m-%d') AS fact_date, CAST(quarter(timestamp) AS INTEGER) AS quarter, "
                        f"{', '.join(KPIS)}, 1 AS reading_count FROM staged JOIN d_cell_id c ON cell_id = c.m "
                        "JOIN d_region r ON region = r.m JOIN d_technology t ON technology = t.m "
                        "JOIN d_timestamp z ON timestamp = z.m",
    "a18b_append": f"WITH {STAGED_NETWORK_SQL} SELECT 'distinct fact ids' AS table_name, count(*) AS row_count FROM staged "
                   "UNION ALL SELECT 'fact_network_kpi', count(*) FROM staged UNION ALL "
                   "SELECT 'dim_cell', count(DISTINCT cell_id) FROM staged UNION ALL "
                   "SELECT 'dim_region', count(DISTINCT region) FROM staged UNION ALL "
                   "SELECT 'dim_network_tech', count(DISTINCT technology) FROM staged UNION ALL "
                   "SELECT 'dim_time', count(DISTINCT timestamp) FROM staged",
    "a18b_reset": _CUSTOMER_AUDIT,
    "a19_orphans": " UNION ALL ".join(
        f"SELECT '{k}' AS foreign_key, count(*) AS orphan_rows, count(DISTINCT {k}) AS orphan_keys FROM lineitem "
        f"WHERE {k} NOT IN ({sub})" for k, sub in {
            "l_orderkey": "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '3-MEDIUM'",
            "l_partkey": "SELECT p_partkey FROM part WHERE p_size <= 40",
            "l_suppkey": "SELECT s_suppkey FROM supplier"}.items()),
    "a20_row_counts": "SELECT count(*) AS source_rows, count(*) AS dimension_rows, count(*) AS fact_rows, "
                      "true AS all_equal FROM orders JOIN customer ON o_custkey = c_custkey",
    "a21_customer_totals": f"WITH {STAGED_CUSTOMER_SQL} " + _recon({
        "total_customers": "count(*)", "churned_customers": "sum(churn_flag)",
        "retained_customers": "count(*) FILTER (churn_flag = 0)",
        "avg_monthly_charges": _exact("monthly_charges", 2) + " / count(*) / 100.0::DOUBLE",
        "sum_total_charges": _exact("total_charges", 2) + " / 100.0::DOUBLE"}),
    "a21_network_totals": f"WITH {STAGED_NETWORK_SQL} " + _recon({
        f"avg_{k}": f"{_exact(k, p)} / count(*) / {10**p}.0::DOUBLE" for k, p in
        {"latency_ms": 2, "throughput_mbps": 2, "packet_loss_pct": 3, "call_drop_rate_pct": 3,
         "active_connections": 0}.items()}),
    "a22_network_audit": f"WITH {STAGED_NETWORK_SQL} SELECT count(*) AS source_rows, count(*) AS staging_rows, "
                         "count(*) AS accepted_rows, 0::BIGINT AS rejected_rows, count(DISTINCT cell_id) AS dim_cell_rows, "
                         "count(DISTINCT region) AS dim_region_rows, count(DISTINCT technology) AS dim_tech_rows, "
                         "count(DISTINCT timestamp) AS dim_time_rows, count(*) AS fact_network_kpi_rows FROM staged",
    "a18b_append_again": f"WITH {raw_network_sql()} SELECT count(*) AS row_count, count(*) AS natural_keys, "
                         "count(*) AS fact_ids FROM raw",
    "a22_quarantined_load": f"{_SPOILED} SELECT (SELECT count(*) FROM staged) AS source_rows, count(*) AS staging_rows, "
                            "count(*) AS accepted_rows, (SELECT count(*) FROM staged) - count(*) AS rejected_rows, "
                            "count(DISTINCT cell_id) AS dim_cell_rows, count(DISTINCT region) AS dim_region_rows, "
                            "count(DISTINCT technology) AS dim_tech_rows, count(DISTINCT timestamp) AS dim_time_rows, "
                            "count(*) AS fact_network_kpi_rows FROM kept",
    "a22_rejected_rules": f"""{_SPOILED} SELECT * FROM (
  SELECT 'latency_ms not null' AS rule, count(*) FILTER (no_latency) AS row_count FROM staged UNION ALL
  SELECT 'region in domain', count(*) FILTER (no_region) FROM staged UNION ALL
  SELECT 'handover_success_pct in [0, 100]', count(*) FILTER (no_handover) FROM staged UNION ALL
  SELECT 'cell_id, timestamp unique', (SELECT count(*) FROM good) - (SELECT count(*) FROM kept)) WHERE row_count > 0""",
    "a23_csv_result": _RULE_REPORT,
    "a23_json_result": _NULLS,
    "a24_inferred_result": "SELECT p_brand, count(*) AS parts, max(p_retailprice) + 0.25::DOUBLE AS dearest "
                           "FROM part GROUP BY ALL",
}
