"""Cart events: action classes, quantity and state flags, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import filled, flag
from ..schemas import CART_ACTIONS
from . import typed

# --- fixed values: action to category ---
CATEGORY = {
    "created": "creation",
    "updated": "modification",
    "removed": "removal",
    "abandoned": "abandonment",
}
LARGE_CART = 10
# --- end of fixed values ---


def filter_carts(df: DataFrame, event_type: str = "cart") -> DataFrame:
    return typed.only_type(df, event_type)


def normalize_action(df: DataFrame) -> DataFrame:
    return typed.normalize(df, "action")


def classify_cart_action(df: DataFrame) -> DataFrame:
    if "action" not in df.columns:
        return df
    return df.withColumn("cart_action_category", typed.label("action", CATEGORY, "other"))


def add_quantity_features(df: DataFrame) -> DataFrame:
    if "quantity" not in df.columns:
        return df
    quantity = F.col("quantity").try_cast("int")
    return df.withColumns(
        {
            "quantity": quantity,
            "large_cart": flag(quantity >= LARGE_CART),
            "single_item_cart": flag(quantity == 1),
        }
    )


def add_cart_state_features(df: DataFrame) -> DataFrame:
    return typed.one_hot(df, "action", "is_cart_", CART_ACTIONS)


def add_customer_features(df: DataFrame) -> DataFrame:
    flags = {"customer_id": "has_customer", "cart_id": "has_cart"}
    found = {name: flag(filled(c)) for c, name in flags.items() if c in df.columns}
    return df.withColumns(found) if found else df


def add_temporal_features(df: DataFrame) -> DataFrame:
    return typed.calendar(df, "cart", ("hour", "day_of_week", "is_weekend"))


def transform(df: DataFrame) -> DataFrame:
    return (
        df.transform(filter_carts)
        .transform(normalize_action)
        .transform(classify_cart_action)
        .transform(add_quantity_features)
        .transform(add_cart_state_features)
        .transform(add_customer_features)
        .transform(add_temporal_features)
    )


def create_summary(df: DataFrame) -> DataFrame:
    return typed.grouped(
        transform(df),
        ["event_date", "product_id", "action", "cart_action_category"],
        [
            typed.rows("cart_event_count"),
            typed.total("quantity", "total_items"),
            typed.distinct("customer_id", "unique_customers"),
            typed.distinct("cart_id", "unique_carts"),
        ],
    )
