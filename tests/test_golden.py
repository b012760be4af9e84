"""The sample events of the retail feed and the totals expected from them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import rules
from tallyhouse.operators import deliveries, refine
from tallyhouse.operators.aggregates import carts, clicks, sales
from tallyhouse.plans import views
from tallyhouse.sources.readers import to_unified

# --- fixed values: sample events, times on 2026-09-12 unless given ---
C1, C2 = "customer-000001", "customer-000002"
P1, P2 = "product-000001", "product-000002"
CLICKS = [
    ("click-000001", "22:00:00", C1, P1, "view"),
    ("click-000002", "22:00:05", C1, P2, "view"),
    ("click-000003", "22:00:12", C2, P1, "add_to_cart"),
]
CARTS = [
    ("cart-000001", "22:01:00", C1, "cart-000001", P1, 2),
    ("cart-000002", "22:01:10", C1, "cart-000001", P2, 1),
    ("cart-000003", "22:01:20", C2, "cart-000002", P1, 1),
]
ORDERS = [
    ("order-000001", "22:02:00", C1, "order-000001", P1, 2, "149.90", "299.80"),
    ("order-000002", "22:03:00", C2, "order-000002", P2, 1, "89.90", "89.90"),
]
DELIVERIES = [
    ("delivery-000001", "2026-09-13 10:00:00", "order-000001", "IN_TRANSIT", None),
    ("delivery-000002", "2026-09-13 11:00:00", "order-000002", "DELIVERED", "2026-09-15 16:30:00"),
]
# --- end of fixed values ---


def day(text: str) -> str:
    return text if " " in text else f"2026-09-12 {text}"


@pytest.fixture(scope="module")
def events(spark):
    def frame(rows, names):
        return spark.createDataFrame([(r[0], day(r[1]), *r[2:]) for r in rows], ["event_id", "event_timestamp", *names])

    text = lambda c: F.lit(c)
    parts = [
        frame(CLICKS, ["customer_id", "product_id", "action"]).withColumns(
            {"event_type": text("CLICK"), "page": text("product-detail")}),
        frame(CARTS, ["customer_id", "cart_id", "product_id", "quantity"]).withColumns(
            {"event_type": text("CART"), "action": text("ADD")}),
        frame(ORDERS, ["customer_id", "order_id", "product_id", "quantity", "unit_price", "total_amount"]).withColumns(
            {"event_type": text("ORDER"), "status": text("COMPLETED")}),
        spark.createDataFrame(
            DELIVERIES, "event_id STRING, event_timestamp STRING, order_id STRING, status STRING, actual_delivery STRING"
        ).withColumns({"event_type": text("DELIVERY"), "delivery_id": F.col("event_id"), "customer_id": text(C1),
                       "carrier": text("transportadora-demo"), "estimated_delivery": text("2026-09-15 18:00:00")}),
    ]
    rows = None
    for part in parts:
        part = to_unified(part.withColumn("ingestion_timestamp", F.col("event_timestamp")))
        rows = part if rows is None else rows.unionByName(part)
    return refine.normalize_events(rows)


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_clicks(events):
    overall = clicks.aggregate_overall(events).first()
    assert (overall.total_clicks, overall.unique_customers, overall.unique_products) == (3, 2, 2)
    assert by(clicks.aggregate_by_customer(events), "customer_id", "click_count") == {C1: 2, C2: 1}
    assert by(clicks.aggregate_by_product(events), "product_id", "click_count") == {P1: 2, P2: 1}


def test_carts(events):
    overall = carts.aggregate_overall(events).first()
    assert (overall.total_cart_events, overall.unique_customers, overall.unique_carts) == (3, 2, 2)
    assert overall.total_items_in_cart_events == 4
    assert by(carts.aggregate_by_product(events), "product_id", "total_quantity") == {P1: 3, P2: 1}
    assert carts.calculate_abandonment_metrics(events).first().active_cart_events == 3


def test_sales(events):
    overall = sales.aggregate_overall(events).first()
    assert (overall.total_orders, overall.total_items_sold) == (2, 3)
    assert overall.total_revenue == 389.70 and overall.average_order_value == 194.85
    assert by(sales.aggregate_by_customer(events), "customer_id", "total_revenue") == {C1: 299.80, C2: 89.90}
    completed = sales.aggregate_overall(events, completed_statuses=["completed"]).first()
    assert completed.total_orders == 2


def test_deliveries(events):
    moved = deliveries.transform(events)
    assert by(moved.groupBy("status").count(), "status", "count") == {"delivered": 1, "in_transit": 1}
    fact = moved.withColumn("event_date", F.to_date("event_timestamp"))
    summary = views.delivery_performance(fact).agg(
        F.sum("total_deliveries").alias("n"), F.sum("deliveries_on_time").alias("ok"),
        F.sum("deliveries_delayed").alias("late")).first()
    assert (summary.n, summary.ok, summary.late) == (2, 1, 0)


def test_early_arrival_is_not_an_error(events):
    rows = events.filter(F.col("event_type") == "delivery")
    judged = rules.judge(rows, rules.delivery_model_rules())
    assert judged.filter(~rules.is_valid()).isEmpty()
