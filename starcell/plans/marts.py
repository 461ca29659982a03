"""The two telecom marts: attribute names, domains and measure blocks.

A mart is described once here and bound to tables by `customer_star` and
`network_star`, or to other column layouts by building `Star` directly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcell.functions import arguments, timeparts
from starcell.functions.labels import TENURE_BANDS, band_filter, band_label
from starcell.plans import measures
from starcell.plans.measures import Measure
from starcell.plans.star import Attribute, Dimension, Star

# The allowed members of each category.
YES_NO = ("Yes", "No")
CONTRACTS = ("Month-to-month", "One year", "Two year")
INTERNET_SERVICES = ("DSL", "Fiber optic", "No")
PAYMENT_METHODS = (
    "Electronic check",
    "Mailed check",
    "Bank transfer (automatic)",
    "Credit card (automatic)",
)
PHONE_OPTION = ("Yes", "No", "No phone service")
INTERNET_OPTION = ("Yes", "No", "No internet service")
GENDERS = ("Male", "Female")
REGIONS = ("Central", "East", "North", "South", "West")
TECHNOLOGIES = ("LTE", "5G")

# Plan attributes in table order, source column -> (name for callers, domain).
PLAN_COLUMNS = {
    "Contract": ("contract", CONTRACTS),
    "PhoneService": ("phone_service", YES_NO),
    "MultipleLines": ("multiple_lines", PHONE_OPTION),
    "InternetService": ("internet_service", INTERNET_SERVICES),
    "OnlineSecurity": ("online_security", INTERNET_OPTION),
    "OnlineBackup": ("online_backup", INTERNET_OPTION),
    "DeviceProtection": ("device_protection", INTERNET_OPTION),
    "TechSupport": ("tech_support", INTERNET_OPTION),
    "StreamingTV": ("streaming_tv", INTERNET_OPTION),
    "StreamingMovies": ("streaming_movies", INTERNET_OPTION),
    "PaperlessBilling": ("paperless_billing", YES_NO),
    "PaymentMethod": ("payment_method", PAYMENT_METHODS),
}

# Plan attributes whose filter values are checked; others just match no row.
CHECKED_NAMES = ("contract", "internet_service", "payment_method")

# Without declared decimals values are summed as doubles. A mart that knows its decimals
# declares them, and its sums are exact; values must then have no more, and no NaN.
EXACT_DIGITS = None

# The seven KPIs, their decimals in storage, decimals in a per-cell summary's average.
KPIS = {
    "latency_ms": (2, 2),
    "throughput_mbps": (2, 2),
    "packet_loss_pct": (3, 3),
    "call_drop_rate_pct": (3, 3),
    "signal_strength_dbm": (2, 2),
    "handover_success_pct": (2, 2),
    "active_connections": (0, 1),
}


def integer(low: int | None = None, high: int | None = None):
    return lambda value: arguments.whole_number(value, "value", low, high)


def band_attribute(tenure: Column, home: str | None, bands=TENURE_BANDS) -> Attribute:
    names = tuple(name for _, name in bands)
    return Attribute(band_label(tenure, bands), home, domain=names,
                     equals=lambda name: band_filter(tenure, name, bands))


def flag_attribute(column: Column) -> Attribute:
    return Attribute(column, None, parse=lambda v: arguments.flag(v, "churn_flag"))


def date_attribute(ts: Column, home: str | None) -> Attribute:
    """A calendar day, filtered as a time range so that it reaches the scan."""

    def on_day(day: str) -> Column:
        try:
            start = datetime.strptime(day, "%Y-%m-%d")
        except ValueError:
            raise ValueError(f"date must look like YYYY-MM-DD, got {day!r}") from None
        low, high = (F.lit(str(d)).cast("timestamp_ntz") for d in (start, start + timedelta(days=1)))
        return (ts >= low) & (ts < high)

    return Attribute(F.date_format(ts, "yyyy-MM-dd"), home, equals=on_day, grain="day")


def time_attributes(ts: Column, home: str | None) -> dict[str, Attribute]:
    parts = timeparts.calendar_parts(ts)
    whole = {name: Attribute(parts[name], home, parse=integer(), grain=grain)
             for name, grain in (("hour", "hour"), ("minute", "minute"), ("day", "day"), ("month", "day"),
                                 ("year", "day"))}
    return {"timestamp": Attribute(ts, home), "date": date_attribute(ts, home), **whole}


def customer_block(count: str, churned: str, retained: str | None,
                   digits: tuple[int | None, int | None] = (EXACT_DIGITS, EXACT_DIGITS),
                   flag: str = "churn_flag", monthly: str = "monthly_charges",
                   total: str | None = "total_charges") -> list[Measure]:
    """Counts, churn rate and average charges under the given output names."""
    block = [measures.row_count(count), measures.count_where(churned, F.col(flag) == 1, f"{flag}__is_1")]
    if retained:
        block.append(measures.count_where(retained, F.col(flag) == 0, f"{flag}__is_0"))
    block.append(measures.mean("churn_rate_pct", flag, 0, factor=100.0))
    block.append(measures.mean("avg_monthly_charges", monthly, digits[0]))
    if total:
        block.append(measures.mean("avg_total_charges", total, digits[1]))
    return block


def kpi_means(digits: Mapping[str, int | None], kpis: Sequence[str] = tuple(KPIS)) -> list[Measure]:
    return [measures.mean(f"avg_{kpi}", kpi, digits[kpi]) for kpi in kpis]


def customer_star(fact: DataFrame, customer: DataFrame, plan: DataFrame) -> Star:
    """Bind the customer mart: fact keyed by customer_key and plan_key."""
    col = F.col
    attributes = {name: Attribute(col(source), "plan",
                                  domain=domain if name in CHECKED_NAMES else None)
                  for source, (name, domain) in PLAN_COLUMNS.items()}
    attributes |= {
        "gender": Attribute(col("gender"), "customer"),
        "senior_citizen": Attribute(col("SeniorCitizen"), "customer", parse=integer()),
        "partner": Attribute(col("Partner"), "customer"),
        "dependents": Attribute(col("Dependents"), "customer"),
        "tenure_band": band_attribute(col("tenure"), "customer"),
        "churn_flag": flag_attribute(col("churn_flag")),
    }
    return Star(fact, {
        "customer": Dimension(customer, "customer_key", "customer_key"),
        "plan": Dimension(plan, "plan_key", "plan_key"),
    }, attributes)


def network_star(fact: DataFrame, cell: DataFrame, region: DataFrame, technology: DataFrame,
                 time: DataFrame) -> Star:
    """Bind the network mart; region and technology hang off the fact.

    A fact that holds its `timestamp` answers questions about time itself; `time` is then only
    a list of the times seen. Without one, times are looked up there.
    """
    col = F.col
    home = None if "timestamp" in fact.columns else "time"
    attributes = {
        "cell_id": Attribute(col("cell_id"), "cell"),
        "region": Attribute(col("region_name"), "region", domain=REGIONS),
        "technology": Attribute(col("technology_name"), "technology", domain=TECHNOLOGIES),
        **time_attributes(col("timestamp"), home),
    }
    return Star(fact, {
        "cell": Dimension(cell, "cell_key", "cell_key"),
        "region": Dimension(region, "region_key", "region_key"),
        "technology": Dimension(technology, "technology_key", "technology_key"),
        "time": Dimension(time, "time_key", "time_key"),
    }, attributes, "fact_date" if "fact_date" in fact.columns else None)
