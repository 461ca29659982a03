"""The given tables as the two marts: column mappings of FIXTURES.md section 5."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcell.functions import arguments
from starcell.operators.cube import CustomerCube, NetworkCube
from starcell.plans.marts import band_attribute, flag_attribute, time_attributes
from starcell.plans.star import Attribute, Dimension, Star

# Members of the given tables' categories.
REGION_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
LINE_STATUSES = ("F", "O")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ORDER_STATUSES = ("F", "O", "P")

# Decimals of the KPIs made from lineitem, and from events.
LINE_DIGITS = {
    "latency_ms": 0, "throughput_mbps": 5, "packet_loss_pct": 2, "call_drop_rate_pct": 2,
    "signal_strength_dbm": 0, "handover_success_pct": 1, "active_connections": 0,
}
EVENT_DIGITS = {
    "latency_ms": 2, "throughput_mbps": 2, "packet_loss_pct": 3, "call_drop_rate_pct": 4,
    "signal_strength_dbm": 3, "handover_success_pct": 3, "active_connections": 0,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cells, each with its region."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("s_name").alias("cell_id"), F.col("r_name").alias("region")))


def line_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as telemetry: one observation per row."""
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.col("l_linestatus").alias("technology"),
        F.col("l_shipdate").alias("timestamp"),
        (quantity * 4).alias("latency_ms"),
        (F.col("l_extendedprice") / 1000).alias("throughput_mbps"),
        (F.col("l_tax") * 100 + 0.0).alias("packet_loss_pct"),
        (F.col("l_discount") * 100 + 0.0).alias("call_drop_rate_pct"),
        (-50 - quantity).alias("signal_strength_dbm"),
        (100 - quantity * 0.5).alias("handover_success_pct"),
        (quantity * 10).cast("int").alias("active_connections"),
    )


def event_kpis(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """events as telemetry with sub-minute times: users as cells."""
    value = F.col("value")
    events = table(spark, sf_dir, "events") if events is None else events
    return events.select(
        "event_id",
        F.concat(F.lit("Cell_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("cell_id"),
        F.col("event_type").alias("technology"),
        F.col("ts").alias("timestamp"),
        value.alias("latency_ms"),
        (value * 2).alias("throughput_mbps"),
        (value / 10).alias("packet_loss_pct"),
        (value / 100).alias("call_drop_rate_pct"),
        (-50 - value / 10).alias("signal_strength_dbm"),
        (100 - value / 10).alias("handover_success_pct"),
        F.floor(value * 10).cast("int").alias("active_connections"),
    )


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the customer fact."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linestatus",
        "l_returnflag",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("churn_flag"),
        F.col("l_extendedprice").alias("monthly_charges"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_charges"),
    )


def _network_star(spark: SparkSession, sf_dir: str) -> Star:
    attributes = {
        "cell_id": Attribute(F.col("cell_id"), "site"),
        "region": Attribute(F.col("region"), "site", domain=REGION_NAMES),
        "technology": Attribute(F.col("technology"), domain=LINE_STATUSES),
        **time_attributes(F.col("timestamp"), None),
    }
    return Star(line_kpis(spark, sf_dir),
                {"site": Dimension(sites(spark, sf_dir), "l_suppkey", "s_suppkey")}, attributes)


def _event_star(spark: SparkSession, sf_dir: str) -> Star:
    attributes = {
        "cell_id": Attribute(F.col("cell_id")),
        "technology": Attribute(F.col("technology")),
        **time_attributes(F.col("timestamp"), None),
    }
    return Star(event_kpis(spark, sf_dir), {}, attributes)


def _customer_star(spark: SparkSession, sf_dir: str) -> Star:
    whole = lambda v: arguments.whole_number(v, "p_size")
    attributes = {
        "contract": Attribute(F.col("o_orderpriority"), "plan", domain=PRIORITIES),
        "internet_service": Attribute(F.col("o_orderstatus"), "plan", domain=ORDER_STATUSES),
        "payment_method": Attribute(F.col("p_type"), "customer"),
        "brand": Attribute(F.col("p_brand"), "customer"),
        "size": Attribute(F.col("p_size"), "customer", parse=whole),
        "tenure_band": band_attribute(F.col("p_size"), "customer"),
        "line_status": Attribute(F.col("l_linestatus"), domain=LINE_STATUSES),
        "return_flag": Attribute(F.col("l_returnflag"), domain=("A", "N", "R")),
        "churn_flag": flag_attribute(F.col("churn_flag")),
    }
    dimensions = {
        "customer": Dimension(table(spark, sf_dir, "part"), "l_partkey", "p_partkey"),
        "plan": Dimension(table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey"),
    }
    return Star(charges(spark, sf_dir), dimensions, attributes)


# A star counts its dimensions once, so it is kept for the session as a warehouse
# connection would be.
@lru_cache(maxsize=16)
def network_star(spark: SparkSession, sf_dir: str) -> Star:
    return _network_star(spark, sf_dir)


@lru_cache(maxsize=16)
def event_star(spark: SparkSession, sf_dir: str) -> Star:
    return _event_star(spark, sf_dir)


@lru_cache(maxsize=16)
def customer_star(spark: SparkSession, sf_dir: str) -> Star:
    return _customer_star(spark, sf_dir)


def network_cube(spark: SparkSession, sf_dir: str) -> NetworkCube:
    return NetworkCube(network_star(spark, sf_dir), LINE_DIGITS,
                       counted={"number_of_cells": "l_suppkey",
                                "number_of_technologies": "technology"},
                       counted_names={"number_of_regions": "region"})


def event_cube(spark: SparkSession, sf_dir: str) -> NetworkCube:
    return NetworkCube(event_star(spark, sf_dir), EVENT_DIGITS,
                       counted={"number_of_cells": "cell_id",
                                "number_of_technologies": "technology"})


def customer_cube(spark: SparkSession, sf_dir: str) -> CustomerCube:
    return CustomerCube(customer_star(spark, sf_dir), (2, 4))
