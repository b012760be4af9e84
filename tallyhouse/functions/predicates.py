"""Business predicates of events and entities, one Column per property."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import as_col, lower_trim, merge_maps, one_of
from .timestamps import difference_seconds

# --- fixed values: accepted spellings, English and Portuguese ---
WORDS = {
    "click_product_interaction": ("view", "click", "select", "details", "open"),
    "click_conversion_intent": ("buy", "checkout", "add_to_cart", "purchase"),
    "cart_addition": ("add", "add_to_cart", "insert"),
    "cart_removal": ("remove", "remove_from_cart", "delete"),
    "cart_update": ("update", "change_quantity", "quantity_update"),
    "cart_abandonment": ("abandon", "abandoned", "timeout"),
    "order_confirmed": ("confirmed", "confirmado"),
    "order_processing": ("processing", "processando"),
    "order_completed": (
        "completed",
        "complete",
        "concluido",
        "concluído",
        "delivered",
        "entregue",
    ),
    "order_cancelled": ("cancelled", "canceled", "cancelado"),
    "delivery_delivered": ("delivered", "entregue", "completed", "complete"),
    "delivery_in_transit": ("in_transit", "in-transit", "transit", "em_transito", "em trânsito"),
    "delivery_pending": ("pending", "aguardando", "preparing", "preparando"),
    "delivery_cancelled": ("cancelled", "canceled", "cancelado"),
    "cart_active": ("active", "open", "aberto", "ativo"),
    "cart_abandoned": ("abandoned", "abandonado", "expired"),
    "cart_converted": ("converted", "convertido", "completed", "concluido", "concluído"),
    "customer_premium": ("premium", "vip", "enterprise"),
    "order_status_final": ("completed", "delivered", "cancelled"),
    "order_status_successful": ("completed", "delivered"),
    "delivery_status_final": ("delivered", "failed", "returned", "cancelled"),
    "delivery_status_successful": ("delivered",),
    "delivery_status_problematic": ("delayed", "failed", "returned", "cancelled"),
    "delivery_status_in_transit": ("shipped", "in_transit", "out_for_delivery"),
    "alert_commercial": ("high_sales_volume", "large_order_value"),
    "alert_logistics": ("late_delivery", "delivery_failure"),
    "alert_behavioral": ("cart_abandonment",),
    "alert_pipeline": ("event_lag", "out_of_order_event", "pipeline_health"),
}
HIGH_VALUE_ORDER = 10000
HIGH_VALUE_PRODUCT = 1000
# --- end of fixed values ---


def word(group: str, value: Column | str) -> Column:
    """Does the text belong to the named vocabulary? (false for null)"""
    return one_of(value, WORDS[group])


def event_delay_seconds(event_ts="event_timestamp", ingestion_ts="ingestion_timestamp") -> Column:
    return difference_seconds(event_ts, ingestion_ts)


def is_late_event(event_ts="event_timestamp", ingestion_ts="ingestion_timestamp") -> Column:
    """Ingested after it happened. One of six meanings of late; see the README."""
    return as_col(ingestion_ts) > as_col(event_ts)


def with_metadata(extra: Column, metadata: Column | str = "metadata") -> Column:
    return merge_maps(metadata, extra)


def is_high_value_order(total="total_amount") -> Column:
    return F.coalesce(as_col(total) >= HIGH_VALUE_ORDER, F.lit(False))


def is_delivered_late(actual="actual_delivery", estimated="estimated_delivery") -> Column:
    return F.coalesce(as_col(actual) > as_col(estimated), F.lit(False))


def delivery_delay_seconds(actual="actual_delivery", estimated="estimated_delivery") -> Column:
    return F.coalesce(difference_seconds(estimated, actual), F.lit(0.0))


def delivery_duration_seconds(created="created_at", actual="actual_delivery") -> Column:
    return F.coalesce(difference_seconds(created, actual), F.lit(0.0))


def order_total(quantity="quantity", price="unit_price") -> Column:
    return as_col(quantity) * as_col(price)


def normalized_email(email="email") -> Column:
    return lower_trim(email)


def is_in_stock(stock="stock_quantity") -> Column:
    return as_col(stock) > 0


def is_out_of_stock(stock="stock_quantity") -> Column:
    return as_col(stock) == 0


def is_high_value_product(price="price") -> Column:
    return F.coalesce(as_col(price) >= HIGH_VALUE_PRODUCT, F.lit(False))
