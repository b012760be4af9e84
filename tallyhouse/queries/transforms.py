"""Row-level transforms per event type, and feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carts, clicks, curate, deliveries, features, refine, sales
from ..sources import relational as R
from .base import amount, big, dbl, flag, query, step, with_ctes

TS = "event_timestamp"


def shouted(source, *columns):
    """The same events with the given columns in upper case and padded."""

    def read(spark, root):
        df = source(spark, root)
        loud = {c: F.concat(F.lit(" "), F.upper(F.col(c)), F.lit(" ")) for c in columns}
        return df.withColumns(loud)

    return read


def without(source, *columns):
    return lambda spark, root: source(spark, root).drop(*columns)


def hour(ts=TS):
    return f"hour({ts})"


def dow(ts=TS):
    return f"(dayofweek({ts}) + 1)"


def calendar(prefix: str, *parts: str) -> dict[str, str]:
    every = {
        "hour": hour(),
        "day_of_week": big(dow()),
        "day_of_month": f"day({TS})",
        "month": f"month({TS})",
        "year": f"year({TS})",
        "is_weekend": flag(f"{dow()} IN (1, 7)"),
    }
    return {f"{prefix}_{p}": every[p] for p in parts}


# ---- sales -------------------------------------------------------------------
step("flt2_sales_only", R.all_events, sales.filter_sales, {"event_type": "event_type"}, "all_ev",
     "WHERE event_type = 'order'")
step("prj10_sales_status", shouted(R.order_events, "status"), sales.normalize_status,
     {"status": "status"}, "order_ev")
step("prj11_sales_numbers", R.order_events, sales.cast_numeric_columns,
     {"quantity": "quantity", "unit_price": amount("unit_cents"), "total_amount": amount("total_cents")},
     "order_ev")
CALC = "(quantity * unit_cents)"
step("prj12_total_check", R.order_events, sales.calculate_total_amount,
     {"calculated_total_amount": amount(CALC), "amount_difference": amount(f"(total_cents - {CALC})")},
     "order_ev")
step("prj12_total_filled", without(R.order_events, "total_amount"), sales.calculate_total_amount,
     {"total_amount": amount(CALC)}, "order_ev")
step("prj13_order_value_class", R.order_events, sales.classify_order_value,
     {"order_value_category": "CASE WHEN total_cents >= 1000000 THEN 'high_value' "
      "WHEN total_cents >= 500000 THEN 'medium_value' ELSE 'standard_value' END"}, "order_ev")
step("prj14_order_value_flags", R.order_events, sales.add_order_value_flags,
     {"is_high_value_order": flag("total_cents >= 1000000"), "is_positive_sale": flag("total_cents > 0")},
     "order_ev")
step("prj15_quantity_flags", R.order_events, sales.add_quantity_features,
     {"large_quantity_order": flag("quantity >= 10"), "multi_item_order": flag("quantity > 1")}, "order_ev")
ORDER_FLAGS = {
    f"is_order_{s}": flag(f"status = '{s}'")
    for s in ("created", "confirmed", "processing", "shipped", "delivered", "cancelled")
}
step("prj16_order_status_flags", R.order_events, sales.add_order_status_flags, ORDER_FLAGS, "order_ev")
SALE_CALENDAR = calendar("sale", "hour", "day_of_week", "day_of_month", "month", "year", "is_weekend")
step("prj17_sale_calendar", R.order_events, sales.add_temporal_features, SALE_CALENDAR, "order_ev")
step("pip5_sales_transform", shouted(R.all_events, "status"), sales.transform,
     {"status": "status", "amount_difference": amount(f"(total_cents - {CALC})"),
      "is_high_value_order": flag("total_cents >= 1000000"), **ORDER_FLAGS, **SALE_CALENDAR},
     "all_ev", "WHERE event_type = 'order'")

# ---- clicks ------------------------------------------------------------------
CLICK_CLASS = (
    "CASE action WHEN 'search' THEN 'search' WHEN 'view' THEN 'navigation' WHEN 'product_view' "
    "THEN 'product_interest' WHEN 'add_to_cart' THEN 'conversion_intent' ELSE 'other' END"
)
CLICK_FLAGS = {
    "is_product_interaction": flag("action IN ('product_view', 'add_to_cart')"),
    "has_conversion_intent": flag("action = 'add_to_cart'"),
}
SESSION = {"has_session": flag("session_id IS NOT NULL AND length(trim(session_id)) > 0")}
CLICK_CALENDAR = calendar("click", "hour", "day_of_week", "is_weekend")
step("flt3_clicks_only", R.all_events, clicks.filter_clicks, {"event_type": "event_type"}, "all_ev",
     "WHERE event_type = 'click'")
step("prj18_click_action", shouted(R.click_events, "action"), clicks.normalize_action,
     {"action": "action"}, "click_ev")
step("prj19_click_class", R.activity_events, clicks.classify_click, {"click_category": CLICK_CLASS},
     "activity_ev")
step("prj20_product_interaction", R.activity_events, clicks.add_product_interaction_flag,
     {"is_product_interaction": CLICK_FLAGS["is_product_interaction"]}, "activity_ev")
step("prj21_conversion_intent", R.activity_events, clicks.add_conversion_intent_flag,
     {"has_conversion_intent": CLICK_FLAGS["has_conversion_intent"]}, "activity_ev")
step("prj22_session_flag", R.all_events, clicks.add_session_features, SESSION, "all_ev")
step("prj23_click_calendar", R.click_events, clicks.add_temporal_features, CLICK_CALENDAR, "click_ev")
step("pip6_click_transform", shouted(R.all_events, "action"), clicks.transform,
     {"action": "action", "click_category": CLICK_CLASS, **CLICK_FLAGS, **SESSION, **CLICK_CALENDAR},
     "all_ev", "WHERE event_type = 'click'")

# ---- carts -------------------------------------------------------------------
CART_CLASS = (
    "CASE action WHEN 'created' THEN 'creation' WHEN 'updated' THEN 'modification' WHEN 'removed' "
    "THEN 'removal' WHEN 'abandoned' THEN 'abandonment' ELSE 'other' END"
)
CART_SIZE = {"large_cart": flag("quantity >= 10"), "single_item_cart": flag("quantity = 1")}
CART_STATE = {
    f"is_cart_{a}": flag(f"action = '{a}'") for a in ("created", "updated", "removed", "abandoned")
}
CART_OWNER = {
    "has_customer": flag("length(trim(customer_id)) > 0"),
    "has_cart": flag("length(trim(cart_id)) > 0"),
}
CART_CALENDAR = calendar("cart", "hour", "day_of_week", "is_weekend")
step("flt4_carts_only", R.all_events, carts.filter_carts, {"event_type": "event_type"}, "all_ev",
     "WHERE event_type = 'cart'")
step("prj24_cart_action", shouted(R.cart_events, "action"), carts.normalize_action,
     {"action": "action"}, "cart_ev")
step("prj25_cart_class", R.activity_events, carts.classify_cart_action,
     {"cart_action_category": CART_CLASS}, "activity_ev")
step("prj26_cart_quantity", R.activity_events, carts.add_quantity_features,
     {"quantity": "quantity", **CART_SIZE}, "activity_ev")
step("prj27_cart_state", R.activity_events, carts.add_cart_state_features, CART_STATE, "activity_ev")
step("prj28_cart_owner", R.all_events, carts.add_customer_features, CART_OWNER, "all_ev")
step("prj29_cart_calendar", R.cart_events, carts.add_temporal_features, CART_CALENDAR, "cart_ev")
step("pip7_cart_transform", shouted(R.all_events, "action"), carts.transform,
     {"action": "action", "cart_action_category": CART_CLASS, **CART_SIZE, **CART_STATE, **CART_OWNER,
      **CART_CALENDAR}, "all_ev", "WHERE event_type = 'cart'")

# ---- deliveries --------------------------------------------------------------
DELAY = "(epoch(event_timestamp) - epoch(estimated_delivery)) / 3600.0"
DELIVERY_FLAGS = {
    f"is_delivery_{s}": flag(f"status = '{s}'")
    for s in ("pending", "in_transit", "out_for_delivery", "delivered", "failed")
}
STAGE = (
    "CASE status WHEN 'pending' THEN 'awaiting_dispatch' WHEN 'in_transit' THEN 'transportation' "
    "WHEN 'out_for_delivery' THEN 'last_mile' WHEN 'delivered' THEN 'completed' WHEN 'failed' THEN "
    "'exception' ELSE 'unknown' END"
)
DELAYS = {"delivery_delay_hours": DELAY, "is_late_delivery": flag(f"{DELAY} > 24")}
COMPLETION = {
    "delivery_completion_hours": "(epoch(actual_delivery) - epoch(event_timestamp)) / 3600.0"
}
OUTCOME = {
    "delivery_success": flag("status = 'delivered'"),
    "delivery_exception": flag("status = 'failed'"),
}
DELAY_CLASS = {
    "delivery_delay_category": f"CASE WHEN {DELAY} <= 0 THEN 'on_time' WHEN {DELAY} <= 24 THEN "
    f"'minor_delay' WHEN {DELAY} <= 72 THEN 'moderate_delay' ELSE 'severe_delay' END"
}
DELIVERY_CALENDAR = calendar("delivery", "hour", "day_of_week", "month", "year", "is_weekend")
step("flt5_deliveries_only", R.all_events, deliveries.filter_deliveries, {"event_type": "event_type"},
     "all_ev", "WHERE event_type = 'delivery'")
step("prj30_delivery_status", shouted(R.delivery_events, "status"), deliveries.normalize_status,
     {"status": "status"}, "delivery_ev")
step("prj31_carrier",
     lambda spark, root: R.delivery_events(spark, root).withColumn(
         "carrier", F.concat(F.lit("  "), F.col("carrier"), F.lit(" "))),
     deliveries.normalize_carrier, {"carrier": "carrier"}, "delivery_ev")
step("prj32_delivery_flags", R.delivery_events, deliveries.add_status_flags, DELIVERY_FLAGS, "delivery_ev")
step("prj33_delivery_stage", R.all_events, deliveries.classify_delivery_status,
     {"delivery_stage": STAGE}, "all_ev")
step("prj34_delivery_delay", R.delivery_events, deliveries.calculate_delivery_delay, DELAYS, "delivery_ev")
step("prj35_completion_time", R.delivery_events, deliveries.calculate_delivery_completion_time,
     COMPLETION, "delivery_ev")
step("prj36_delivery_calendar", R.delivery_events, deliveries.add_temporal_features, DELIVERY_CALENDAR,
     "delivery_ev")
step("prj37_logistics_quality",
     lambda spark, root: deliveries.calculate_delivery_delay(R.all_events(spark, root)),
     deliveries.add_logistics_quality_features, {**OUTCOME, **DELAY_CLASS}, "all_ev")
step("pip8_delivery_transform", shouted(R.all_events, "status"), deliveries.transform,
     {"status": "status", "carrier": "carrier", "delivery_stage": STAGE, **DELIVERY_FLAGS, **DELAYS,
      **COMPLETION, **DELIVERY_CALENDAR, **OUTCOME, **DELAY_CLASS},
     "all_ev", "WHERE event_type = 'delivery'")

# ---- features ----------------------------------------------------------------


def ln1p(expr: str) -> str:
    return f"round(ln(1 + {expr}), 6)"


def rounded_logs(df):
    logs = ["quantity_log", "unit_price_log", "total_amount_log"]
    return df.withColumns({c: F.round(c, 6) for c in logs})


KIND = {f"is_{k}_event": flag(f"event_type = '{k}'") for k in ("click", "cart", "order", "delivery")}
LOGS = {
    "quantity_log": ln1p(dbl("quantity")),
    "unit_price_log": ln1p(amount("unit_cents")),
    "total_amount_log": ln1p(amount("total_cents")),
    "high_value_order": flag("total_cents >= 1000000"),
}
WHEN = {
    "event_hour": hour(),
    "event_day_of_week": big(dow()),
    "event_day_of_month": f"day({TS})",
    "event_month": f"month({TS})",
    "event_year": f"year({TS})",
    "is_weekend": flag(f"{dow()} IN (1, 7)"),
    "is_business_hour": flag(f"{hour()} BETWEEN 8 AND 18"),
}
PARCEL = {
    "is_delivery_completed": flag("status = 'delivered'"),
    "is_delivery_failed": flag("status = 'failed'"),
    "is_delivery_in_transit": flag("status = 'in_transit'"),
    "is_out_for_delivery": flag("status = 'out_for_delivery'"),
}
WAIT = "(epoch_us(ingestion_timestamp) - epoch_us(event_timestamp)) // 1000000"
LATENCY = {"event_ingestion_delay_seconds": big(WAIT), "late_event": flag(f"{WAIT} > 10")}
BEHAVIOR = {
    "is_product_view": flag("event_type = 'click' AND action = 'product_view'"),
    "is_add_to_cart_click": flag("event_type = 'click' AND action = 'add_to_cart'"),
}
step("fea1_activity_features", R.all_events, features.add_customer_activity_features, KIND, "all_ev")
step("fea2_sales_features", R.all_events, lambda df: rounded_logs(features.add_sales_features(df)),
     LOGS, "all_ev")
step("fea3_temporal_features", R.all_events, features.add_temporal_features, WHEN, "all_ev")
step("fea4_delivery_features", R.all_events, features.add_delivery_features, PARCEL, "all_ev")
step("fea5_latency_features", R.all_events, features.add_latency_features, LATENCY, "all_ev")
step("fea6_behavior_features", R.all_events, features.add_behavior_features, BEHAVIOR, "all_ev")
step("pip9_feature_table", R.all_events, lambda df: rounded_logs(features.build_features(df)),
     {**KIND, **LOGS, **WHEN, **PARCEL, **LATENCY, **BEHAVIOR}, "all_ev")
