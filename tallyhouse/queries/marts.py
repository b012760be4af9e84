"""Daily marts and per-type summaries and aggregates."""

from __future__ import annotations

from ..operators import carts, clicks, deliveries, sales
from ..operators.aggregates import carts as agg_carts
from ..operators.aggregates import clicks as agg_clicks
from ..operators.aggregates import daily
from ..operators.aggregates import deliveries as agg_deliveries
from ..operators.aggregates import sales as agg_sales
from ..operators.refine import normalize_events
from ..sources import relational as R
from .base import amount, big, mean, mean_2, query, round_2, total, with_ctes

DAY = "CAST(event_timestamp AS DATE) AS event_date"
DELAY = "(epoch(event_timestamp) - epoch(estimated_delivery)) / 3600.0"


def dated(source):
    return lambda spark, root: normalize_events(source(spark, root))


ORDERS, DELIVERIES = dated(R.order_events), dated(R.delivery_events)
CLICKS, CARTS, EVERYTHING = dated(R.click_events), dated(R.cart_events), dated(R.all_events)


def of_types(*types):
    """The part of the feed with these event types."""
    return lambda spark, root: R.all_events(spark, root, types)


def grouped(name, source, fn, select: str, cte: str, by: str = "", where: str = "", having: str = ""):
    """Register an aggregate: ``select`` over the CTE, grouped by all plain columns."""
    group = "GROUP BY ALL" if by else ""
    body = f"SELECT {by + ',' if by else ''} {select} FROM {cte} {where} {group} {having}"

    @query(name, with_ctes(body, cte))
    def run(spark, root):
        return fn(source(spark, root))

    return run


# ---- daily marts -----------------------------------------------------------
grouped(
    "ag1_daily_sales",
    ORDERS,
    lambda df: daily.daily_sales_summary(sales.transform(df), ordered=False),
    f"count(*) AS total_orders, count(DISTINCT order_id) AS unique_orders, "
    f"count(DISTINCT customer_id) AS unique_customers, {big('sum(quantity)')} AS total_items, "
    f"{total()} AS total_sales, {mean_2()} AS average_order_value",
    "order_ev",
    DAY,
)
grouped(
    "ag2_event_date",
    R.all_events,
    lambda df: daily.prepare_date_column(df).select("event_id", "event_date"),
    "event_id, CAST(event_timestamp AS DATE) AS event_date",
    "all_ev",
)
grouped(
    "ag3_events_by_day",
    R.all_events,
    lambda df: daily.aggregate_events_by_day(df, ordered=False),
    "count(*) AS total_events, count(DISTINCT customer_id) AS unique_customers, "
    "count(DISTINCT product_id) AS unique_products",
    "all_ev",
    DAY,
)
grouped(
    "ag4_sales_by_day",
    R.all_events,
    lambda df: daily.aggregate_sales_by_day(df, ordered=False),
    f"count(*) AS total_orders, {big('sum(quantity)')} AS total_items_sold, {total()} AS total_sales, "
    f"{mean_2()} AS average_order_value, {amount('max(total_cents)')} AS highest_order_value",
    "all_ev",
    DAY,
    "WHERE event_type = 'order'",
)
grouped(
    "ag5_clicks_by_day",
    R.all_events,
    lambda df: daily.aggregate_clicks_by_day(df, ordered=False),
    "count(*) AS total_clicks, count(DISTINCT customer_id) AS unique_click_customers, "
    "count(DISTINCT product_id) AS unique_clicked_products",
    "all_ev",
    DAY,
    "WHERE event_type = 'click'",
)
grouped(
    "ag6_carts_by_day",
    R.all_events,
    lambda df: daily.aggregate_carts_by_day(df, ordered=False),
    f"count(*) AS total_cart_events, count(DISTINCT cart_id) AS unique_carts, "
    f"{big('sum(quantity)')} AS total_cart_items",
    "all_ev",
    DAY,
    "WHERE event_type = 'cart'",
)
grouped(
    "ag7_deliveries_by_day",
    R.all_events,
    lambda df: daily.aggregate_deliveries_by_day(df, ordered=False),
    "count(*) AS total_delivery_events, count(DISTINCT order_id) AS unique_delivery_orders, "
    "count(*) FILTER (status = 'delivered') AS delivered_orders, "
    "count(*) FILTER (status = 'failed') AS failed_orders",
    "all_ev",
    DAY,
    "WHERE event_type = 'delivery'",
)
grouped(
    "ag8_by_day_and_type",
    R.all_events,
    lambda df: daily.aggregate_by_event_type(df, ordered=False),
    "count(*) AS event_count, count(DISTINCT customer_id) AS unique_customers",
    "all_ev",
    f"{DAY}, event_type",
)

# ---- per-type summaries -----------------------------------------------------
VALUE_CLASS = (
    "CASE WHEN total_cents >= 1000000 THEN 'high_value' WHEN total_cents >= 500000 "
    "THEN 'medium_value' ELSE 'standard_value' END AS order_value_category"
)
grouped(
    "ag9_sales_summary",
    ORDERS,
    sales.create_summary,
    f"count(*) AS order_count, {big('sum(quantity)')} AS total_quantity, {total()} AS total_sales, "
    f"{mean_2()} AS average_order_value, {amount('max(total_cents)')} AS maximum_order_value, "
    "count(DISTINCT customer_id) AS unique_customers",
    "order_ev",
    f"{DAY}, product_id, status, {VALUE_CLASS}",
)
grouped(
    "ag10_click_summary",
    CLICKS,
    clicks.create_summary,
    "count(*) AS click_count, count(DISTINCT customer_id) AS unique_customers, "
    "count(DISTINCT session_id) AS unique_sessions",
    "click_ev",
    f"{DAY}, product_id, action, CASE action WHEN 'search' THEN 'search' WHEN 'view' THEN "
    "'navigation' WHEN 'product_view' THEN 'product_interest' WHEN 'add_to_cart' THEN "
    "'conversion_intent' ELSE 'other' END AS click_category",
)
grouped(
    "ag11_cart_summary",
    CARTS,
    carts.create_summary,
    f"count(*) AS cart_event_count, {big('sum(quantity)')} AS total_items, "
    "count(DISTINCT customer_id) AS unique_customers, count(DISTINCT cart_id) AS unique_carts",
    "cart_ev",
    f"{DAY}, product_id, action, CASE action WHEN 'created' THEN 'creation' WHEN 'updated' THEN "
    "'modification' WHEN 'removed' THEN 'removal' WHEN 'abandoned' THEN 'abandonment' "
    "ELSE 'other' END AS cart_action_category",
)
STAGE = (
    "CASE status WHEN 'pending' THEN 'awaiting_dispatch' WHEN 'in_transit' THEN 'transportation' "
    "WHEN 'out_for_delivery' THEN 'last_mile' WHEN 'delivered' THEN 'completed' "
    "WHEN 'failed' THEN 'exception' ELSE 'unknown' END"
)
DELAY_CLASS = (
    f"CASE WHEN {DELAY} <= 0 THEN 'on_time' WHEN {DELAY} <= 24 THEN 'minor_delay' "
    f"WHEN {DELAY} <= 72 THEN 'moderate_delay' ELSE 'severe_delay' END"
)
grouped(
    "ag12_delivery_summary",
    DELIVERIES,
    deliveries.create_summary,
    "count(*) AS delivery_event_count, count(DISTINCT order_id) AS unique_orders, "
    f"count(DISTINCT customer_id) AS unique_customers, {round_2(f'avg({DELAY})')} AS average_delay_hours",
    "delivery_ev",
    f"{DAY}, carrier, status, {STAGE} AS delivery_stage, {DELAY_CLASS} AS delivery_delay_category",
)

# ---- sales aggregates -------------------------------------------------------
REVENUE = f"{total()} AS total_revenue, {mean()} AS average_order_value"
SPAN = f"{amount('min(total_cents)')} AS minimum_order_value, {amount('max(total_cents)')} AS maximum_order_value"
OVERALL = f"count(*) AS total_orders, {REVENUE}, {SPAN}, {big('sum(quantity)')} AS total_items_sold"

grouped(
    "as1_prepare_sales",
    R.all_events,
    lambda df: agg_sales.prepare(df).select("event_id", "event_date", "quantity", "total_amount", "status"),
    f"event_id, {DAY}, quantity, {amount('total_cents')} AS total_amount, status",
    "all_ev",
    where="WHERE event_type = 'order'",
)
grouped("as2_sales_overall", of_types("order"), agg_sales.aggregate_overall, OVERALL, "all_ev",
        where="WHERE event_type = 'order'")
grouped("as3_sales_daily", R.order_events, lambda df: agg_sales.aggregate_daily(df, ordered=False),
        OVERALL, "order_ev", DAY)
grouped("as4_sales_by_status", R.order_events,
        lambda df: agg_sales.aggregate_by_status(df, ordered=False),
        f"count(*) AS order_count, {REVENUE}", "order_ev", "status")
grouped(
    "as5_sales_by_customer",
    R.order_events,
    lambda df: agg_sales.aggregate_by_customer(df, ordered=False),
    f"count(*) AS order_count, {REVENUE}, {amount('max(total_cents)')} AS highest_order_value, "
    "sum(total_cents) >= 1000000 AS high_value_customer",
    "order_ev",
    "customer_id",
)
grouped("as6_sales_by_product", R.order_events,
        lambda df: agg_sales.aggregate_by_product(df, ordered=False),
        f"count(*) AS order_count, {REVENUE}, {big('sum(quantity)')} AS total_quantity_sold",
        "order_ev", "product_id")
grouped(
    "as7_high_value_orders",
    R.order_events,
    agg_sales.aggregate_high_value_orders,
    "count(*) FILTER (total_cents >= 1000000) AS high_value_order_count, "
    f"{total('CASE WHEN total_cents >= 1000000 THEN total_cents ELSE 0 END')} AS high_value_revenue",
    "order_ev",
)
grouped("as8_sales_by_day_and_status", R.order_events,
        lambda df: agg_sales.aggregate_by_day_and_status(df, ordered=False),
        f"count(*) AS order_count, {REVENUE}", "order_ev", f"{DAY}, status")
grouped("as9_sales_run_completed", R.order_events,
        lambda df: agg_sales.run(df, completed_statuses=["completed", "delivered"]),
        OVERALL, "order_ev", where="WHERE status IN ('completed', 'delivered')")

# ---- click aggregates -------------------------------------------------------
PEOPLE = "count(DISTINCT customer_id) AS unique_customers"
VISITS = "count(DISTINCT session_id) AS unique_sessions"
grouped("ac1_prepare_clicks", R.all_events,
        lambda df: agg_clicks.prepare(df).select("event_id", "event_date", "action", "page"),
        f"event_id, {DAY}, action, page", "all_ev", where="WHERE event_type = 'click'")
grouped("ac2_clicks_overall", R.all_events, agg_clicks.aggregate_overall,
        f"count(*) AS total_clicks, {PEOPLE}, {VISITS}, count(DISTINCT product_id) AS unique_products",
        "all_ev", where="WHERE event_type = 'click'")
grouped("ac3_clicks_daily", R.click_events, lambda df: agg_clicks.aggregate_daily(df, ordered=False),
        f"count(*) AS total_clicks, {PEOPLE}, {VISITS}", "click_ev", DAY)
grouped("ac4_clicks_by_product", R.click_events,
        lambda df: agg_clicks.aggregate_by_product(df, ordered=False),
        f"count(*) AS click_count, {PEOPLE}, {VISITS}", "click_ev", "product_id")
grouped("ac5_clicks_by_page", R.click_events,
        lambda df: agg_clicks.aggregate_by_page(df, ordered=False),
        f"count(*) AS click_count, {PEOPLE}", "click_ev", "page")
grouped("ac6_clicks_by_action", R.click_events,
        lambda df: agg_clicks.aggregate_by_action(df, ordered=False),
        f"count(*) AS click_count, {PEOPLE}", "click_ev", "action")
grouped("ac7_clicks_by_day_and_page", R.click_events,
        lambda df: agg_clicks.aggregate_by_day_and_page(df, ordered=False),
        f"count(*) AS click_count, {PEOPLE}", "click_ev", f"{DAY}, page")
grouped(
    "ac8_clicks_by_customer",
    R.click_events,
    lambda df: agg_clicks.aggregate_by_customer(df, ordered=False),
    "count(*) AS click_count, count(DISTINCT session_id) AS session_count, "
    "count(DISTINCT product_id) AS products_interacted, count(DISTINCT page) AS pages_visited",
    "click_ev",
    "customer_id",
)
grouped("ac9_clicks_run", R.click_events, agg_clicks.run,
        f"count(*) AS total_clicks, {PEOPLE}, {VISITS}, count(DISTINCT product_id) AS unique_products",
        "click_ev")

# ---- cart aggregates --------------------------------------------------------
BASKETS = "count(DISTINCT cart_id) AS unique_carts"
ITEMS = f"{big('sum(quantity)')} AS total_quantity"
CART_OVERALL = (
    f"count(*) AS total_cart_events, {BASKETS}, {PEOPLE}, count(DISTINCT product_id) AS "
    f"unique_products, {big('sum(quantity)')} AS total_items_in_cart_events"
)
grouped("ak1_prepare_carts", R.all_events,
        lambda df: agg_carts.prepare(df).select("event_id", "event_date", "action", "quantity"),
        f"event_id, {DAY}, action, quantity", "all_ev", where="WHERE event_type = 'cart'")
grouped("ak2_carts_overall", R.all_events, agg_carts.aggregate_overall, CART_OVERALL, "all_ev",
        where="WHERE event_type = 'cart'")
grouped("ak3_carts_daily", R.cart_events, lambda df: agg_carts.aggregate_daily(df, ordered=False),
        f"count(*) AS cart_event_count, {BASKETS}, {PEOPLE}, {ITEMS}", "cart_ev", DAY)
grouped("ak4_carts_by_action", R.cart_events,
        lambda df: agg_carts.aggregate_by_action(df, ordered=False),
        f"count(*) AS event_count, {BASKETS}, {PEOPLE}, {ITEMS}", "cart_ev", "action")
grouped("ak5_carts_by_product", R.cart_events,
        lambda df: agg_carts.aggregate_by_product(df, ordered=False),
        f"count(*) AS cart_event_count, {BASKETS}, {PEOPLE}, {ITEMS}", "cart_ev", "product_id")
grouped("ak6_carts_by_customer", R.cart_events,
        lambda df: agg_carts.aggregate_by_customer(df, ordered=False),
        "count(*) AS cart_event_count, count(DISTINCT cart_id) AS cart_count, "
        f"count(DISTINCT product_id) AS products_interacted, {ITEMS}", "cart_ev", "customer_id")
grouped("ak7_carts_by_day_and_action", R.cart_events,
        lambda df: agg_carts.aggregate_daily_by_action(df, ordered=False),
        f"count(*) AS event_count, {BASKETS}, {ITEMS}", "cart_ev", f"{DAY}, action")
grouped(
    "ak8_cart_abandonment",
    R.cart_events,
    lambda df: agg_carts.calculate_abandonment_metrics(df, contract_actions=True),
    "count(*) FILTER (action IN ('add','add_to_cart','update','created','updated')) AS active_cart_events, "
    "count(*) FILTER (action IN ('checkout','purchase','converted')) AS conversion_events, "
    "count(*) FILTER (action IN ('abandon','abandoned')) AS abandonment_events, "
    "count(*) FILTER (action IN ('remove','removed')) AS removal_events",
    "cart_ev",
)
grouped("ak9_carts_run", R.cart_events, agg_carts.run, CART_OVERALL, "cart_ev")

# ---- delivery aggregates ----------------------------------------------------


def moved(spark, root):
    return deliveries.transform(R.delivery_events(spark, root))


SHIPMENTS = "count(DISTINCT delivery_id) AS unique_deliveries"
ORDERED = "count(DISTINCT order_id) AS unique_orders"
AVG_DELAY = f"avg({DELAY}) AS average_delay_hours"
MAX_DELAY = f"max({DELAY}) AS maximum_delay_hours"
DELIVERY_OVERALL = f"count(*) AS total_delivery_events, {SHIPMENTS}, {ORDERED}, {AVG_DELAY}, {MAX_DELAY}"
grouped("ad1_prepare_deliveries", moved,
        lambda df: agg_deliveries.prepare(df).select(
            "event_id", "event_date", "status", "carrier", "delivery_delay_hours",
            "delivery_completion_hours"),
        f"event_id, {DAY}, status, carrier, {DELAY} AS delivery_delay_hours, "
        "(epoch(actual_delivery) - epoch(event_timestamp)) / 3600.0 AS delivery_completion_hours",
        "delivery_ev")
grouped("ad2_deliveries_overall", moved, agg_deliveries.aggregate_overall, DELIVERY_OVERALL, "delivery_ev")
grouped("ad3_deliveries_daily", moved,
        lambda df: agg_deliveries.aggregate_daily(df, ordered=False),
        f"count(*) AS delivery_event_count, {SHIPMENTS}, {ORDERED}, {AVG_DELAY}", "delivery_ev", DAY)
grouped("ad4_deliveries_by_status", moved,
        lambda df: agg_deliveries.aggregate_by_status(df, ordered=False),
        f"count(*) AS delivery_event_count, {SHIPMENTS}, {ORDERED}, {AVG_DELAY}", "delivery_ev", "status")
grouped("ad5_deliveries_by_carrier", moved,
        lambda df: agg_deliveries.aggregate_by_carrier(df, ordered=False),
        f"count(*) AS delivery_event_count, {SHIPMENTS}, {ORDERED}, {AVG_DELAY}, {MAX_DELAY}",
        "delivery_ev", "carrier")
grouped("ad6_deliveries_by_order", moved,
        lambda df: agg_deliveries.aggregate_by_order(df, ordered=False),
        f"count(*) AS delivery_event_count, count(DISTINCT delivery_id) AS delivery_count, {MAX_DELAY}",
        "delivery_ev", "order_id")
grouped("ad7_delay_metrics", moved, agg_deliveries.calculate_delay_metrics,
        f"count(*) AS total_deliveries, count(*) FILTER ({DELAY} > 24) AS late_delivery_count, "
        f"count(*) FILTER ({DELAY} <= 24) AS on_time_delivery_count, {AVG_DELAY}, {MAX_DELAY}",
        "delivery_ev")
grouped("ad8_deliveries_by_day_and_status", moved,
        lambda df: agg_deliveries.aggregate_daily_by_status(df, ordered=False),
        f"count(*) AS delivery_event_count, {SHIPMENTS}", "delivery_ev", f"{DAY}, status")
grouped("ad9_deliveries_run", moved, agg_deliveries.run, DELIVERY_OVERALL, "delivery_ev")
