"""Order metrics: overall, per day, status, customer, product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.basics import (
    MONEY,
    count_when,
    max_money,
    min_money,
    lower_trim,
    mean_money,
    require,
    sum_money,
)
from .. import typed
from .common import summarise, with_event_date

HIGH_VALUE = 10000

COUNT = typed.rows("order_count")
REVENUE = [
    typed.measure("total_amount", "total_revenue", sum_money),
    typed.measure("total_amount", "average_order_value", mean_money),
]
RANGE = [
    typed.measure("total_amount", "minimum_order_value", min_money),
    typed.measure("total_amount", "maximum_order_value", max_money),
]


def prepare(
    df: DataFrame, event_type: str = "order", completed_statuses: Sequence[str] | None = None
) -> DataFrame:
    """Order rows with typed measures; pass statuses to keep completed orders only."""
    require(df, "event_type", "total_amount")
    out = typed.only_type(df, event_type)
    changes = {"total_amount": F.col("total_amount").try_cast(MONEY)}
    if "quantity" in out.columns:
        changes["quantity"] = F.col("quantity").try_cast("long")
    if "status" in out.columns:
        changes["status"] = lower_trim("status")
    out = with_event_date(out.withColumns(changes))
    if completed_statuses:
        out = out.filter(F.col("status").isin(*completed_statuses))
    return out


def _overall_measures() -> list:
    items = typed.total("quantity", "total_items_sold")
    return [typed.rows("total_orders"), *REVENUE, *RANGE, items]


def aggregate_overall(df: DataFrame, **options) -> DataFrame:
    return summarise(prepare(df, **options), [], _overall_measures())


def aggregate_daily(df: DataFrame, ordered: bool = True, **options) -> DataFrame:
    return summarise(
        prepare(df, **options), ["event_date"], _overall_measures(), ["event_date"], ordered=ordered
    )


def aggregate_by_status(df: DataFrame, ordered: bool = True, **options) -> DataFrame:
    return summarise(
        prepare(df, **options), ["status"], [COUNT, *REVENUE], [F.desc("order_count")], ordered=ordered
    )


def aggregate_by_customer(
    df: DataFrame, ordered: bool = True, high_value: float = HIGH_VALUE, **options
) -> DataFrame:
    highest = typed.measure("total_amount", "highest_order_value", max_money)
    out = summarise(
        prepare(df, **options),
        ["customer_id"],
        [COUNT, *REVENUE, highest],
        drop_null="customer_id",
    ).withColumn("high_value_customer", F.col("total_revenue") >= high_value)
    return out.orderBy(F.desc("total_revenue")) if ordered else out


def aggregate_by_product(df: DataFrame, ordered: bool = True, **options) -> DataFrame:
    return summarise(
        prepare(df, **options),
        ["product_id"],
        [COUNT, *REVENUE, typed.total("quantity", "total_quantity_sold")],
        [F.desc("total_revenue")],
        ordered=ordered,
        drop_null="product_id",
    )


def aggregate_high_value_orders(
    df: DataFrame, high_value: float = HIGH_VALUE, **options
) -> DataFrame:
    high = F.col("total_amount") >= high_value
    revenue = F.coalesce(F.sum(F.when(high, F.col("total_amount"))), F.lit(0).cast(MONEY))
    return prepare(df, **options).agg(
        count_when(high).alias("high_value_order_count"),
        revenue.cast("double").alias("high_value_revenue"),
    )


def aggregate_by_day_and_status(df: DataFrame, ordered: bool = True, **options) -> DataFrame:
    return summarise(
        prepare(df, **options),
        ["event_date", "status"],
        [COUNT, *REVENUE],
        ["event_date", "status"],
        ordered=ordered,
    )


run = aggregate_overall
