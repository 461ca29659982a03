"""Hand-made rows shared by the tests."""

from datetime import datetime

from starcell.plans.marts import KPIS

OBSERVATION = ("cell_id string, region string, technology string, timestamp timestamp_ntz, "
               "latency_ms double, throughput_mbps double, packet_loss_pct double, "
               "call_drop_rate_pct double, signal_strength_dbm double, handover_success_pct double, "
               "active_connections int")

# The documented reading of one cell.
CELL_25 = ("Cell_0025", "Central", "5G", datetime(2026, 8, 3, 14, 0), 3.73, 289.16, 1.179, 0.607, -63.7,
           97.21, 395)


def observations(spark, rows):
    return spark.createDataFrame(rows, OBSERVATION)


def readings(spark, **changes):
    """One observation with some KPIs replaced."""
    row = dict(zip(("cell_id", "region", "technology", "timestamp", *KPIS), CELL_25))
    row.update(changes)
    return observations(spark, [tuple(row.values())])


def network_csv_rows():
    """Text telemetry: 4 cells, 3 minutes."""
    regions = ("North", "South", "North", "East")
    return [(f"2026-08-03 14:0{m}:00", f" Cell_000{c}", regions[c], "5G" if c % 2 else "LTE",
             f"{10 + c + m}.5", f"{100 * (c + 1)}.25", "0.125", f"{c}.{m}5", "-60.5", "97.25", str(100 + c))
            for c in range(4) for m in range(3)]


NETWORK_CSV = ("timestamp string, cell_id string, region string, technology string, latency_ms string, "
               "throughput_mbps string, packet_loss_pct string, call_drop_rate_pct string, "
               "signal_strength_dbm string, handover_success_pct string, active_connections string")


def account(number: int, **changes) -> dict:
    row = {
        "customerID": f"{number:04d}-ABC", "gender": "Female", "SeniorCitizen": "0", "Partner": "Yes",
        "Dependents": "No", "tenure": str(number % 73), "Contract": "One year", "PhoneService": "Yes",
        "MultipleLines": "No", "InternetService": "DSL", "OnlineSecurity": "Yes", "OnlineBackup": "No",
        "DeviceProtection": "No", "TechSupport": "Yes", "StreamingTV": "No", "StreamingMovies": "No",
        "PaperlessBilling": "Yes", "PaymentMethod": "Mailed check", "MonthlyCharges": "20.15",
        "TotalCharges": f"{20.15 * (number % 73):.2f}" if number % 73 else " ", "Churn": "No",
    }
    row.update(changes)
    return row


def accounts(spark, rows):
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows],
                                 ", ".join(f"{n} string" for n in names))
