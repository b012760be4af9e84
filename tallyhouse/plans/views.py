"""Seven analytic views over the star schema, as DataFrame functions and as SQL views.

Facts are reduced to their group keys before a dimension is joined, so the join
carries groups instead of rows and a hot customer or product stays cheap. The
second grouping repeats the first one's partitioning and only matters when a
dimension holds a business key twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basics import count_when
from ..schemas import COMPLETED_STATUSES
from .warehouse import Databases

VIEW_NAMES = (
    "vw_sales_daily",
    "vw_sales_by_product",
    "vw_customer_sales",
    "vw_customer_behavior",
    "vw_cart_behavior",
    "vw_delivery_performance",
    "vw_sales_delivery",
)


def completed(sales: DataFrame, statuses: Sequence[str] = COMPLETED_STATUSES) -> DataFrame:
    return sales.filter(F.col("status").isin(*statuses))


def total(column: str) -> Column:
    return F.sum(column).cast("double")


def mean(column: str) -> Column:
    return F.try_divide(total(column), F.count(column))


def sales_daily(sales: DataFrame, statuses=COMPLETED_STATUSES) -> DataFrame:
    return completed(sales, statuses).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("total_sales"),
        F.count_distinct("order_id").alias("total_orders"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.sum("quantity").alias("total_items"),
        total("total_amount").alias("gross_revenue"),
        mean("total_amount").alias("average_order_value"),
    )


def with_product(rows: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """Left join to product and category names; small sides broadcast by their statistics."""
    named = products.select("product_id", F.col("name").alias("product_name"), "category_id")
    kinds = categories.select("category_id", F.col("name").alias("category_name"))
    return rows.join(named, "product_id", "left").join(kinds, "category_id", "left")


def sales_by_product(
    sales: DataFrame, products: DataFrame, categories: DataFrame, statuses=COMPLETED_STATUSES
) -> DataFrame:
    per_product = completed(sales, statuses).groupBy("event_date", "product_id").agg(
        F.sum("quantity").alias("_q"),
        F.sum("total_amount").alias("_a"),
        F.count_distinct("order_id").alias("_o"),
    )
    names = ["product_name", "category_id", "category_name"]
    return (
        with_product(per_product, products, categories)
        .groupBy("event_date", "product_id", *names)
        .agg(
            F.sum("_q").alias("total_quantity"),
            total("_a").alias("total_revenue"),
            F.max("_o").alias("total_orders"),
        )
    )


def customer_sales(sales: DataFrame, customers: DataFrame, statuses=COMPLETED_STATUSES) -> DataFrame:
    per_customer = completed(sales, statuses).groupBy("customer_id").agg(
        F.count_distinct("order_id").alias("_o"),
        F.sum("quantity").alias("_q"),
        F.sum("total_amount").alias("_a"),
        F.count("total_amount").alias("_n"),
        F.min("event_date").alias("_first"),
        F.max("event_date").alias("_last"),
    )
    named = customers.select("customer_id", F.col("name").alias("customer_name"), "segment")
    return (
        per_customer.join(named, "customer_id", "left")
        .groupBy("customer_id", "customer_name", "segment")
        .agg(
            F.max("_o").alias("total_orders"),
            F.sum("_q").alias("total_items"),
            total("_a").alias("total_spent"),
            F.try_divide(total("_a"), F.sum("_n")).alias("average_order_value"),
            F.min("_first").alias("first_purchase_date"),
            F.max("_last").alias("last_purchase_date"),
        )
    )


def customer_behavior(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_clicks"),
        F.count_distinct("product_id").alias("unique_products_clicked"),
        F.count_distinct("session_id").alias("total_sessions"),
    )


def cart_behavior(carts: DataFrame) -> DataFrame:
    return carts.groupBy("customer_id").agg(
        F.count_distinct("cart_id").alias("total_carts"),
        F.sum("quantity").alias("total_items_added"),
        F.count(F.lit(1)).alias("total_cart_events"),
    )


def delivery_performance(deliveries: DataFrame) -> DataFrame:
    """On time and delayed by arrival against estimate; unknown times are in neither."""
    actual, estimated = F.col("actual_delivery"), F.col("estimated_delivery")
    return deliveries.groupBy("event_date", "carrier").agg(
        F.count(F.lit(1)).alias("total_deliveries"),
        count_when(actual <= estimated).alias("deliveries_on_time"),
        count_when(actual > estimated).alias("deliveries_delayed"),
    )


def sales_delivery(sales: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Sale rows with the delivery rows of their order; several deliveries repeat the sale."""
    left = sales.select(
        "order_id", "customer_id", "product_id", F.col("event_date").alias("sale_date"), "total_amount"
    )
    right = deliveries.select(
        "order_id",
        "delivery_id",
        F.col("status").alias("delivery_status"),
        "carrier",
        "estimated_delivery",
        "actual_delivery",
    )
    return left.join(right, "order_id", "left")


# ---- the same views as catalog objects ------------------------------------
def _statuses_sql(statuses: Sequence[str]) -> str:
    return ", ".join(f"'{s}'" for s in statuses)


def view_sql(names: Databases, statuses: Sequence[str] = COMPLETED_STATUSES) -> dict[str, str]:
    core = names.core
    done = f"s.status IN ({_statuses_sql(statuses)})"
    return {
        "vw_sales_daily": f"""
            SELECT s.event_date, count(1) AS total_sales,
                   count(DISTINCT s.order_id) AS total_orders,
                   count(DISTINCT s.customer_id) AS unique_customers,
                   sum(s.quantity) AS total_items,
                   CAST(sum(s.total_amount) AS DOUBLE) AS gross_revenue,
                   CAST(sum(s.total_amount) AS DOUBLE) / count(s.total_amount) AS average_order_value
            FROM {core}.fact_sales s WHERE {done} GROUP BY s.event_date""",
        "vw_sales_by_product": f"""
            SELECT s.event_date, s.product_id, p.name AS product_name, p.category_id,
                   c.name AS category_name, sum(s.quantity) AS total_quantity,
                   CAST(sum(s.total_amount) AS DOUBLE) AS total_revenue,
                   count(DISTINCT s.order_id) AS total_orders
            FROM {core}.fact_sales s
            LEFT JOIN {core}.dim_product p USING (product_id)
            LEFT JOIN {core}.dim_category c ON c.category_id = p.category_id
            WHERE {done} GROUP BY ALL""",
        "vw_customer_sales": f"""
            SELECT s.customer_id, c.name AS customer_name, c.segment,
                   count(DISTINCT s.order_id) AS total_orders, sum(s.quantity) AS total_items,
                   CAST(sum(s.total_amount) AS DOUBLE) AS total_spent,
                   CAST(sum(s.total_amount) AS DOUBLE) / count(s.total_amount) AS average_order_value,
                   min(s.event_date) AS first_purchase_date, max(s.event_date) AS last_purchase_date
            FROM {core}.fact_sales s LEFT JOIN {core}.dim_customer c USING (customer_id)
            WHERE {done} GROUP BY ALL""",
        "vw_customer_behavior": f"""
            SELECT customer_id, count(1) AS total_clicks,
                   count(DISTINCT product_id) AS unique_products_clicked,
                   count(DISTINCT session_id) AS total_sessions
            FROM {core}.fact_clicks GROUP BY customer_id""",
        "vw_cart_behavior": f"""
            SELECT customer_id, count(DISTINCT cart_id) AS total_carts,
                   sum(quantity) AS total_items_added, count(1) AS total_cart_events
            FROM {core}.fact_carts GROUP BY customer_id""",
        "vw_delivery_performance": f"""
            SELECT event_date, carrier, count(1) AS total_deliveries,
                   count_if(actual_delivery <= estimated_delivery) AS deliveries_on_time,
                   count_if(actual_delivery > estimated_delivery) AS deliveries_delayed
            FROM {core}.fact_deliveries GROUP BY event_date, carrier""",
        "vw_sales_delivery": f"""
            SELECT s.order_id, s.customer_id, s.product_id, s.event_date AS sale_date,
                   s.total_amount, d.delivery_id, d.status AS delivery_status, d.carrier,
                   d.estimated_delivery, d.actual_delivery
            FROM {core}.fact_sales s LEFT JOIN {core}.fact_deliveries d USING (order_id)""",
    }


def create_views(
    spark: SparkSession, names: Databases, statuses: Sequence[str] = COMPLETED_STATUSES
) -> None:
    for name, text in view_sql(names, statuses).items():
        spark.sql(f"CREATE OR REPLACE VIEW {names.analytics}.{name} AS {text}")
