"""Delivery metrics: overall, per day, status, carrier, order, delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.basics import count_when, lower_trim, require
from .. import typed
from .common import summarise, with_event_date

LATE_AFTER_HOURS = 24.0

COUNT = typed.rows("delivery_event_count")
DELIVERIES = typed.distinct("delivery_id", "unique_deliveries")
ORDERS = typed.distinct("order_id", "unique_orders")
MEAN_DELAY = typed.measure("delivery_delay_hours", "average_delay_hours", F.avg)
MAX_DELAY = typed.measure("delivery_delay_hours", "maximum_delay_hours", F.max)


def prepare(df: DataFrame, event_type: str = "delivery") -> DataFrame:
    require(df, "event_type")
    out = with_event_date(typed.only_type(df, event_type))
    changes = {}
    if "status" in out.columns:
        changes["status"] = lower_trim("status")
    if "carrier" in out.columns:
        changes["carrier"] = F.trim("carrier")
    for name in ("delivery_delay_hours", "delivery_completion_hours"):
        if name in out.columns:
            changes[name] = F.col(name).try_cast("double")
    return out.withColumns(changes) if changes else out


def aggregate_overall(df: DataFrame) -> DataFrame:
    measures = [typed.rows("total_delivery_events"), DELIVERIES, ORDERS, MEAN_DELAY, MAX_DELAY]
    return summarise(prepare(df), [], measures)


def aggregate_daily(df: DataFrame, ordered: bool = True) -> DataFrame:
    measures = [COUNT, DELIVERIES, ORDERS, MEAN_DELAY]
    return summarise(prepare(df), ["event_date"], measures, ["event_date"], ordered=ordered)


def _by(df: DataFrame, key: str, measures: list, ordered: bool) -> DataFrame:
    order = [F.desc("delivery_event_count")]
    return summarise(prepare(df), [key], measures, order, ordered=ordered, drop_null=key)


def aggregate_by_status(df: DataFrame, ordered: bool = True) -> DataFrame:
    return _by(df, "status", [COUNT, DELIVERIES, ORDERS, MEAN_DELAY], ordered)


def aggregate_by_carrier(df: DataFrame, ordered: bool = True) -> DataFrame:
    return _by(df, "carrier", [COUNT, DELIVERIES, ORDERS, MEAN_DELAY, MAX_DELAY], ordered)


def aggregate_by_order(df: DataFrame, ordered: bool = True) -> DataFrame:
    deliveries = typed.distinct("delivery_id", "delivery_count")
    return _by(df, "order_id", [COUNT, deliveries, MAX_DELAY], ordered)


def calculate_delay_metrics(df: DataFrame, late_after_hours: float = LATE_AFTER_HOURS) -> DataFrame:
    """A delivery without a known delay is neither late nor on time."""
    require(df, "delivery_delay_hours")
    delay = F.col("delivery_delay_hours")
    return prepare(df).agg(
        F.count(F.lit(1)).alias("total_deliveries"),
        count_when(delay > late_after_hours).alias("late_delivery_count"),
        count_when(delay <= late_after_hours).alias("on_time_delivery_count"),
        F.avg(delay).alias("average_delay_hours"),
        F.max(delay).alias("maximum_delay_hours"),
    )


def aggregate_daily_by_status(df: DataFrame, ordered: bool = True) -> DataFrame:
    by = ["event_date", "status"]
    return summarise(prepare(df), by, [COUNT, DELIVERIES], by, ordered=ordered)


run = aggregate_overall
