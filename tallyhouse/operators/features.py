"""Feature columns over curated events. All narrow: no shuffle anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import flag, present, seconds_between

# --- fixed values ---
HIGH_VALUE = 10000
LATE_AFTER_SECONDS = 10
BUSINESS_HOURS = (8, 18)
WEEKEND = (1, 7)
# --- end of fixed values ---


def add_customer_activity_features(df: DataFrame) -> DataFrame:
    if not {"customer_id", "event_type"} <= set(df.columns):
        return df
    kinds = ("click", "cart", "order", "delivery")
    return df.withColumns({f"is_{k}_event": flag(F.col("event_type") == k) for k in kinds})


def add_sales_features(df: DataFrame) -> DataFrame:
    numbers = present(df, ["quantity", "unit_price", "total_amount"])
    out = {f"{c}_log": F.log1p(F.col(c).try_cast("double")) for c in numbers}
    if "total_amount" in numbers:
        out["high_value_order"] = flag(F.col("total_amount") >= HIGH_VALUE)
    return df.withColumns(out) if out else df


def add_temporal_features(df: DataFrame) -> DataFrame:
    if "event_timestamp" not in df.columns:
        return df
    ts = F.col("event_timestamp")
    return df.withColumns(
        {
            "event_hour": F.hour(ts),
            "event_day_of_week": F.dayofweek(ts),
            "event_day_of_month": F.dayofmonth(ts),
            "event_month": F.month(ts),
            "event_year": F.year(ts),
            "is_weekend": flag(F.dayofweek(ts).isin(*WEEKEND)),
            "is_business_hour": flag(F.hour(ts).between(*BUSINESS_HOURS)),
        }
    )


def add_delivery_features(df: DataFrame) -> DataFrame:
    if "status" not in df.columns:
        return df
    status = F.col("status")
    return df.withColumns(
        {
            "is_delivery_completed": flag(status == "delivered"),
            "is_delivery_failed": flag(status == "failed"),
            "is_delivery_in_transit": flag(status == "in_transit"),
            "is_out_for_delivery": flag(status == "out_for_delivery"),
        }
    )


def add_latency_features(df: DataFrame) -> DataFrame:
    """``late_event``: ingested more than ten seconds after it happened."""
    if not {"event_timestamp", "ingestion_timestamp"} <= set(df.columns):
        return df
    delay = seconds_between("event_timestamp", "ingestion_timestamp")
    return df.withColumns(
        {
            "event_ingestion_delay_seconds": delay,
            "late_event": flag(delay > LATE_AFTER_SECONDS),
        }
    )


def add_behavior_features(df: DataFrame) -> DataFrame:
    if not {"event_type", "action"} <= set(df.columns):
        return df
    click = F.col("event_type") == "click"
    return df.withColumns(
        {
            "is_product_view": flag(click & (F.col("action") == "product_view")),
            "is_add_to_cart_click": flag(click & (F.col("action") == "add_to_cart")),
        }
    )


def build_features(df: DataFrame) -> DataFrame:
    return (
        df.transform(add_customer_activity_features)
        .transform(add_sales_features)
        .transform(add_temporal_features)
        .transform(add_delivery_features)
        .transform(add_latency_features)
        .transform(add_behavior_features)
    )
