"""Delivery events: stage, delay, quality classes, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import flag, present, seconds_between
from ..schemas import DELIVERY_STATUSES
from . import typed

# --- fixed values: status to stage, delay limits in hours ---
STAGE = {
    "pending": "awaiting_dispatch",
    "in_transit": "transportation",
    "out_for_delivery": "last_mile",
    "delivered": "completed",
    "failed": "exception",
}
MINOR_DELAY, MODERATE_DELAY = 24, 72
# --- end of fixed values ---


@dataclass(frozen=True)
class DeliveryConfig:
    event_type: str = "delivery"
    late_after_hours: int = 24


DEFAULT = DeliveryConfig()


def filter_deliveries(df: DataFrame, config: DeliveryConfig = DEFAULT) -> DataFrame:
    return typed.only_type(df, config.event_type)


def normalize_status(df: DataFrame) -> DataFrame:
    return typed.normalize(df, "status")


def normalize_carrier(df: DataFrame) -> DataFrame:
    return df.withColumn("carrier", F.trim("carrier")) if "carrier" in df.columns else df


def add_status_flags(df: DataFrame) -> DataFrame:
    return typed.one_hot(df, "status", "is_delivery_", DELIVERY_STATUSES)


def classify_delivery_status(df: DataFrame) -> DataFrame:
    if "status" not in df.columns:
        return df
    return df.withColumn("delivery_stage", typed.label("status", STAGE, "unknown"))


def calculate_delivery_delay(df: DataFrame, config: DeliveryConfig = DEFAULT) -> DataFrame:
    """Hours from the estimate to the event (not to the arrival), and the late flag."""
    if not {"event_timestamp", "estimated_delivery"} <= set(df.columns):
        return df
    hours = seconds_between("estimated_delivery", "event_timestamp") / F.lit(3600.0)
    return df.withColumns(
        {
            "delivery_delay_hours": hours,
            "is_late_delivery": flag(hours > config.late_after_hours),
        }
    )


def calculate_delivery_completion_time(df: DataFrame) -> DataFrame:
    if not {"event_timestamp", "actual_delivery"} <= set(df.columns):
        return df
    hours = seconds_between("event_timestamp", "actual_delivery") / F.lit(3600.0)
    return df.withColumn("delivery_completion_hours", hours)


def add_temporal_features(df: DataFrame) -> DataFrame:
    return typed.calendar(df, "delivery", ("hour", "day_of_week", "month", "year", "is_weekend"))


def add_logistics_quality_features(df: DataFrame) -> DataFrame:
    """Outcome flags and delay class; an unknown delay counts as ``severe_delay``."""
    out = {}
    if "status" in df.columns:
        out["delivery_success"] = flag(F.col("status") == "delivered")
        out["delivery_exception"] = flag(F.col("status") == "failed")
    if "delivery_delay_hours" in df.columns:
        delay = F.col("delivery_delay_hours")
        out["delivery_delay_category"] = (
            F.when(delay <= 0, "on_time")
            .when(delay <= MINOR_DELAY, "minor_delay")
            .when(delay <= MODERATE_DELAY, "moderate_delay")
            .otherwise("severe_delay")
        )
    return df.withColumns(out) if out else df


def transform(df: DataFrame, config: DeliveryConfig = DEFAULT) -> DataFrame:
    return (
        df.transform(filter_deliveries, config)
        .transform(normalize_status)
        .transform(normalize_carrier)
        .transform(add_status_flags)
        .transform(classify_delivery_status)
        .transform(calculate_delivery_delay, config)
        .transform(calculate_delivery_completion_time)
        .transform(add_temporal_features)
        .transform(add_logistics_quality_features)
    )


def create_summary(df: DataFrame, config: DeliveryConfig = DEFAULT) -> DataFrame:
    """Per day, carrier, status, stage and delay class. The stage follows from the status, so it is added to the groups."""
    keys = ["event_date", "carrier", "status", "delivery_stage", "delivery_delay_category"]
    rows = transform(df, config)
    known = "status" in rows.columns
    summary = typed.grouped(
        rows,
        [k for k in keys if not (known and k == "delivery_stage")],
        [
            typed.rows("delivery_event_count"),
            typed.distinct("order_id", "unique_orders"),
            typed.distinct("customer_id", "unique_customers"),
            typed.measure(
                "delivery_delay_hours", "average_delay_hours", lambda c: F.round(F.avg(c), 2)
            ),
        ],
    )
    out = classify_delivery_status(summary)
    keys = present(out, keys)
    return out.select(*keys, *[c for c in summary.columns if c not in keys])
