"""Daily marts over curated events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.basics import count_when, max_money, mean_money_2, require, sum_money
from .. import typed
from .common import summarise, with_event_date


def prepare_date_column(df: DataFrame) -> DataFrame:
    return with_event_date(df)


def _of_type(df: DataFrame, event_type: str) -> DataFrame:
    require(df, "event_type")
    return typed.only_type(with_event_date(df), event_type)


def aggregate_events_by_day(df: DataFrame, ordered: bool = True) -> DataFrame:
    return summarise(
        with_event_date(df),
        ["event_date"],
        [
            typed.rows("total_events"),
            typed.distinct("customer_id", "unique_customers"),
            typed.distinct("product_id", "unique_products"),
        ],
        ["event_date"],
        ordered=ordered,
    )


def aggregate_sales_by_day(df: DataFrame, ordered: bool = True) -> DataFrame:
    return summarise(
        _of_type(df, "order"),
        ["event_date"],
        [
            typed.rows("total_orders"),
            typed.total("quantity", "total_items_sold"),
            typed.measure("total_amount", "total_sales", sum_money),
            typed.measure("total_amount", "average_order_value", mean_money_2),
            typed.measure("total_amount", "highest_order_value", max_money),
        ],
        ["event_date"],
        ordered=ordered,
    )


def aggregate_clicks_by_day(df: DataFrame, ordered: bool = True) -> DataFrame:
    return summarise(
        _of_type(df, "click"),
        ["event_date"],
        [
            typed.rows("total_clicks"),
            typed.distinct("customer_id", "unique_click_customers"),
            typed.distinct("product_id", "unique_clicked_products"),
        ],
        ["event_date"],
        ordered=ordered,
    )


def aggregate_carts_by_day(df: DataFrame, ordered: bool = True) -> DataFrame:
    return summarise(
        _of_type(df, "cart"),
        ["event_date"],
        [
            typed.rows("total_cart_events"),
            typed.distinct("cart_id", "unique_carts"),
            typed.total("quantity", "total_cart_items"),
        ],
        ["event_date"],
        ordered=ordered,
    )


def aggregate_deliveries_by_day(df: DataFrame, ordered: bool = True) -> DataFrame:
    return summarise(
        _of_type(df, "delivery"),
        ["event_date"],
        [
            typed.rows("total_delivery_events"),
            typed.distinct("order_id", "unique_delivery_orders"),
            typed.measure("status", "delivered_orders", lambda c: count_when(F.col(c) == "delivered")),
            typed.measure("status", "failed_orders", lambda c: count_when(F.col(c) == "failed")),
        ],
        ["event_date"],
        ordered=ordered,
    )


def aggregate_by_event_type(df: DataFrame, ordered: bool = True) -> DataFrame:
    require(df, "event_type")
    return summarise(
        with_event_date(df),
        ["event_date", "event_type"],
        [typed.rows("event_count"), typed.distinct("customer_id", "unique_customers")],
        ["event_date", "event_type"],
        ordered=ordered,
    )


def daily_sales_summary(sales: DataFrame, ordered: bool = True) -> DataFrame:
    """The batch job's curated table: one row per day over transformed order events."""
    return summarise(
        with_event_date(sales),
        ["event_date"],
        [
            typed.rows("total_orders"),
            typed.distinct("order_id", "unique_orders"),
            typed.distinct("customer_id", "unique_customers"),
            typed.total("quantity", "total_items"),
            typed.measure("total_amount", "total_sales", sum_money),
            typed.measure("total_amount", "average_order_value", mean_money_2),
        ],
        ["event_date"],
        ordered=ordered,
    )
