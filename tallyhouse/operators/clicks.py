"""Click events: intent classes, session flag, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import filled, flag
from . import typed

# --- fixed values: action to category ---
CATEGORY = {
    "search": "search",
    "view": "navigation",
    "product_view": "product_interest",
    "add_to_cart": "conversion_intent",
}
INTERACTIONS = ("product_view", "add_to_cart")
CONVERSION = "add_to_cart"
# --- end of fixed values ---


def filter_clicks(df: DataFrame, event_type: str = "click") -> DataFrame:
    return typed.only_type(df, event_type)


def normalize_action(df: DataFrame) -> DataFrame:
    return typed.normalize(df, "action")


def classify_click(df: DataFrame) -> DataFrame:
    if "action" not in df.columns:
        return df
    return df.withColumn("click_category", typed.label("action", CATEGORY, "other"))


def add_product_interaction_flag(df: DataFrame) -> DataFrame:
    if "action" not in df.columns:
        return df
    return df.withColumn("is_product_interaction", flag(F.col("action").isin(*INTERACTIONS)))


def add_conversion_intent_flag(df: DataFrame) -> DataFrame:
    if "action" not in df.columns:
        return df
    return df.withColumn("has_conversion_intent", flag(F.col("action") == CONVERSION))


def add_session_features(df: DataFrame) -> DataFrame:
    if "session_id" not in df.columns:
        return df
    return df.withColumn("has_session", flag(filled("session_id")))


def add_temporal_features(df: DataFrame) -> DataFrame:
    return typed.calendar(df, "click", ("hour", "day_of_week", "is_weekend"))


def transform(df: DataFrame) -> DataFrame:
    return (
        df.transform(filter_clicks)
        .transform(normalize_action)
        .transform(classify_click)
        .transform(add_product_interaction_flag)
        .transform(add_conversion_intent_flag)
        .transform(add_session_features)
        .transform(add_temporal_features)
    )


def create_summary(df: DataFrame) -> DataFrame:
    return typed.grouped(
        transform(df),
        ["event_date", "product_id", "action", "click_category"],
        [
            typed.rows("click_count"),
            typed.distinct("customer_id", "unique_customers"),
            typed.distinct("session_id", "unique_sessions"),
        ],
    )
