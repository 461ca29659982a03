"""Raw telecom files made from the given tables.

Each column is one SQL expression that Spark and the oracle both run, so the two
sides start from the same text.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver.tables import table
from starcell.operators import loading
from starcell.plans.marts import KPIS
from starcell.session import fresh_path
from starcell.sources.warehouse import Warehouse

# An account per order; the buyer gives the personal attributes.
MONTHS = "((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)"
PHONE = "o_orderpriority <> '5-LOW'"


def _option(test: str) -> str:
    return (f"CASE WHEN o_orderstatus = 'P' THEN 'No internet service' WHEN {test} THEN 'Yes' "
            "ELSE 'No' END")


def _yes(test: str) -> str:
    return f"CASE WHEN {test} THEN 'Yes' ELSE 'No' END"


RAW_CUSTOMER = {
    "customerID": "'C' || lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '0')",
    "gender": "CASE WHEN c_nationkey < 12 THEN ' Male' ELSE 'Female ' END",
    "SeniorCitizen": "CASE WHEN c_acctbal < 500 THEN '1' ELSE '0' END",
    "Partner": _yes("c_nationkey IN (1, 4, 9, 16, 20)"),
    "Dependents": _yes("c_mktsegment IN ('BUILDING', 'HOUSEHOLD')"),
    "tenure": f"CAST({MONTHS} AS VARCHAR(20))",
    "Contract": "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Month-to-month' "
                "WHEN c_mktsegment = 'FURNITURE' THEN 'One year' ELSE 'Two year' END",
    "PhoneService": _yes(PHONE),
    "MultipleLines": f"CASE WHEN NOT ({PHONE}) THEN 'No phone service' WHEN c_acctbal > 5000 "
                     "THEN 'Yes' ELSE 'No' END",
    "InternetService": "CASE WHEN o_orderstatus = 'O' THEN 'DSL' WHEN o_orderstatus = 'F' "
                       "THEN 'Fiber optic' ELSE 'No' END",
    "OnlineSecurity": _option("o_totalprice > 300000"),
    "OnlineBackup": _option("o_totalprice < 200000"),
    "DeviceProtection": _option("c_acctbal > 2500"),
    "TechSupport": _option("c_nationkey > 17"),
    "StreamingTV": _option("o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "StreamingMovies": _option("o_orderpriority IN ('1-URGENT', '3-MEDIUM')"),
    "PaperlessBilling": _yes("c_acctbal > 1000"),
    "PaymentMethod": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Electronic check' WHEN '2-HIGH' "
                     "THEN 'Mailed check' WHEN '3-MEDIUM' THEN 'Bank transfer (automatic)' "
                     "ELSE 'Credit card (automatic)' END",
    "MonthlyCharges": "CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR(20))",
    "TotalCharges": f"CASE WHEN {MONTHS} = 0 OR o_totalprice < 1500 THEN ' ' ELSE "
                    f"CAST(CAST(o_totalprice AS DECIMAL(12, 2)) * {MONTHS} AS VARCHAR(20)) END",
    "Churn": _yes("(o_totalprice < 200000 AND o_orderstatus <> 'P') "
                  "OR (o_orderpriority = '1-URGENT' AND c_mktsegment <> 'FURNITURE')"),
}

RAW_NETWORK = {
    "cell_id": "' Cell_' || lpad(CAST(user_id AS VARCHAR(20)), 6, '0') || ' '",
    "region": "CASE event_type WHEN 'signup' THEN 'Central' WHEN 'error' THEN 'East' "
              "WHEN 'click' THEN 'North' WHEN 'view' THEN 'South' ELSE ' West' END",
    "technology": "CASE WHEN value < 40 THEN 'LTE' ELSE '5G' END",
    "latency_ms": "CAST(CAST(value AS DECIMAL(12, 2)) AS VARCHAR(20))",
    "throughput_mbps": "CAST(CAST(value AS DECIMAL(12, 2)) * 2 AS VARCHAR(20))",
    "packet_loss_pct": "CAST(CAST(value / 10 AS DECIMAL(12, 3)) AS VARCHAR(20))",
    "call_drop_rate_pct": "CAST(CAST(value / 50 AS DECIMAL(12, 3)) AS VARCHAR(20))",
    "signal_strength_dbm": "CAST(CAST(-50 - floor(value) / 10 AS DECIMAL(12, 2)) AS VARCHAR(20))",
    "handover_success_pct": "CAST(CAST(100 - floor(value) / 10 AS DECIMAL(12, 2)) AS VARCHAR(20))",
    "active_connections": "CAST(CAST(floor(value) AS INTEGER) AS VARCHAR(20))",
}
STAMP_FORMATS = {"second": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
                 "fine": ("yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"),
                 "minute": ("yyyy-MM-dd HH:mm:00", "%Y-%m-%d %H:%M:00")}


def raw_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(*[F.expr(e).cast("string").alias(n) for n, e in RAW_CUSTOMER.items()])


def raw_network(spark: SparkSession, sf_dir: str, stamp: str = "fine") -> DataFrame:
    text = F.date_format("ts", STAMP_FORMATS[stamp][0]).alias("timestamp")
    # lpad cuts what is longer: from a million users on, several would be one cell, whose keys may then repeat.
    user = F.col("user_id").cast("string")
    whole = {"cell_id": F.concat(F.lit(" Cell_"), F.when(F.length(user) > 6, user).otherwise(F.lpad(user, 6, "0")), F.lit(" "))}
    return table(spark, sf_dir, "events").select(
        text, *[whole.get(n, F.expr(e).cast("string")).alias(n) for n, e in RAW_NETWORK.items()])


# Decimals of the loaded marts.
MONEY_DIGITS = (6, 6)
KPI_DIGITS = dict.fromkeys(KPIS, 6)


@lru_cache(maxsize=16)
def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Both marts loaded once per session into the shared folder, with their partial aggregates."""
    house = Warehouse(spark, fresh_path(spark, "warehouse"))
    loading.load_customer(house, raw_customer(spark, sf_dir), rollup_digits=MONEY_DIGITS)
    loading.load_network(house, raw_network(spark, sf_dir), rollup_digits=KPI_DIGITS)
    return house


def _columns(expressions: dict) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in expressions.items())


RAW_CUSTOMER_SQL = (f"raw AS (SELECT {_columns(RAW_CUSTOMER)} FROM orders JOIN customer "
                    "ON o_custkey = c_custkey)")


def raw_network_sql(stamp: str = "fine") -> str:
    return (f"raw AS (SELECT strftime(ts, '{STAMP_FORMATS[stamp][1]}') AS timestamp, "
            f"{_columns(RAW_NETWORK)} FROM events)")


BAND = ("CASE WHEN tenure <= 12 THEN '0-12 months' WHEN tenure <= 24 THEN '13-24 months' "
        "WHEN tenure <= 48 THEN '25-48 months' ELSE '49-72 months' END")

_NUMBERS = ("MonthlyCharges", "TotalCharges", "Churn", "tenure", "SeniorCitizen")

# Staged rows as the loader makes them.
STAGED_CUSTOMER_SQL = f"""{RAW_CUSTOMER_SQL},
typed AS (SELECT {", ".join(f"trim({c}) AS {c}" for c in RAW_CUSTOMER if c not in _NUMBERS)},
  CAST(trim(tenure) AS INTEGER) AS tenure, CAST(trim(SeniorCitizen) AS INTEGER) AS SeniorCitizen,
  CAST(trim(MonthlyCharges) AS DOUBLE) AS monthly_charges,
  CASE WHEN trim(TotalCharges) = '' THEN 0.0::DOUBLE
    ELSE CAST(nullif(trim(TotalCharges), '') AS DOUBLE) END AS total_charges,
  CASE trim(Churn) WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS churn_flag FROM raw),
staged AS (SELECT *, {BAND} AS tenure_band FROM typed)"""

STAGED_NETWORK_SQL = f"""{raw_network_sql()},
staged AS (SELECT CAST(timestamp AS TIMESTAMP) AS timestamp, trim(cell_id) AS cell_id,
  trim(region) AS region, trim(technology) AS technology,
  {", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in RAW_NETWORK
             if k not in ("cell_id", "region", "technology", "active_connections"))},
  CAST(active_connections AS INTEGER) AS active_connections FROM raw)"""
