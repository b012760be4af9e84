"""Enrichment and orphan joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deliveries as D
from ..operators import joins as J
from ..operators.typed import typed_view
from ..sources import relational as R
from .base import amount, big, mean, mean_2, query, total, with_ctes


def rekeyed(df, key, keep, mark="x-"):
    """Other keys where the condition fails, so that both sides have orphans and no row is cut."""
    return df.withColumn(key, F.when(keep, F.col(key)).otherwise(F.concat(F.lit(mark), key)))


def rekeyed_sql(source: str, key: str, keep: str, mark: str = "x-") -> str:
    return f"(SELECT * REPLACE (CASE WHEN {keep} THEN {key} ELSE '{mark}' || {key} END AS {key}) FROM {source})"


def some_customers(spark, root):
    """Customers of whom those of two segments have keys that no order has."""
    kept = F.col("segment").isin("MACHINERY", "BUILDING", "FURNITURE")
    return rekeyed(R.dim_customer(spark, root), "customer_id", kept)


SOME = rekeyed_sql("dcust", "customer_id", "segment IN ('MACHINERY', 'BUILDING', 'FURNITURE')")


def gappy_orders(spark, root):
    """Order events where small quantities lost their customer."""
    return R.order_events(spark, root).withColumn(
        "customer_id", F.when(F.col("quantity") > 3, F.col("customer_id"))
    )


GAPPY = "(SELECT * REPLACE (CASE WHEN quantity > 3 THEN customer_id END AS customer_id) FROM order_ev)"

for kind, sql_kind in (("left", "LEFT"), ("inner", "INNER"), ("right", "RIGHT"), ("outer", "FULL")):

    @query(f"jn1_orders_customers_{kind}", with_ctes(
        f"SELECT coalesce(o.customer_id, c.customer_id) AS customer_id, o.event_id, c.name, c.segment "
        f"FROM (SELECT * FROM {GAPPY} WHERE customer_id IS NOT NULL) o {sql_kind} JOIN {SOME} c "
        "ON o.customer_id = c.customer_id", "order_ev", "dcust"))
    def _(spark, root, kind=kind):
        joined = J.join_orders_customers(gappy_orders(spark, root), some_customers(spark, root), kind)
        return joined.select("customer_id", "event_id", "name", "segment")


for kind, negate in (("left_semi", ""), ("left_anti", "NOT ")):

    @query(f"jn1_orders_customers_{kind}", with_ctes(
        f"SELECT customer_id, event_id FROM {GAPPY} o WHERE customer_id IS NOT NULL AND "
        f"customer_id {negate}IN (SELECT customer_id FROM {SOME})", "order_ev", "dcust"))
    def _(spark, root, kind=kind):
        joined = J.join_orders_customers(gappy_orders(spark, root), some_customers(spark, root), kind)
        return joined.select("customer_id", "event_id")


@query("jn2_customer_columns", with_ctes(
    "SELECT customer_id, customer_sk AS customer_order_id, segment AS customer_status, name FROM dcust", "dcust"))
def _(spark, root):
    dim = R.dim_customer(spark, root).select(
        "customer_id", F.col("customer_sk").alias("order_id"), F.col("segment").alias("status"), "name"
    )
    return J.prepare_customer_columns(dim)


@query("jn3_orders_customers_alias", with_ctes(
    f"SELECT o.event_id, o.customer_id, c.name FROM {GAPPY} o LEFT JOIN {SOME} c "
    "ON o.customer_id = c.customer_id", "order_ev", "dcust"))
def _(spark, root):
    joined = J.join_with_customer_alias(gappy_orders(spark, root), some_customers(spark, root))
    return joined.select("orders.event_id", "orders.customer_id", "customers.name")


@query("jn4_orders_without_customer", with_ctes(
    f"SELECT event_id, customer_id FROM {GAPPY} WHERE customer_id IS NOT NULL AND customer_id NOT IN "
    f"(SELECT customer_id FROM {SOME})", "order_ev", "dcust"))
def _(spark, root):
    out = J.find_orders_without_customer(gappy_orders(spark, root), some_customers(spark, root))
    return out.select("event_id", "customer_id")


@query("jn5_customers_without_orders", with_ctes(
    "SELECT customer_id, name FROM dcust WHERE customer_id NOT IN "
    f"(SELECT customer_id FROM {rekeyed_sql('order_ev', 'customer_id', 'total_cents >= 9500000')})", "order_ev", "dcust"))
def _(spark, root):
    large = rekeyed(R.order_events(spark, root), "customer_id", F.col("total_amount") >= 95000)
    return J.find_customers_without_orders(large, R.dim_customer(spark, root)).select("customer_id", "name")


@query("jn6_valid_orders", with_ctes(
    f"SELECT event_id, customer_id FROM {GAPPY} WHERE customer_id IS NOT NULL", "order_ev"))
def _(spark, root):
    return J.filter_valid_orders(gappy_orders(spark, root)).select("event_id", "customer_id")


@query("jn7_valid_customers", with_ctes(
    "SELECT customer_id FROM dcust WHERE segment <> 'BUILDING'", "dcust"))
def _(spark, root):
    dim = R.dim_customer(spark, root).withColumn(
        "customer_id", F.when(F.col("segment") != "BUILDING", F.col("customer_id"))
    )
    return J.filter_valid_customers(dim).select("customer_id")


@query("jn8_customer_sales_summary", with_ctes(
    f"SELECT customer_id, count(*) AS order_count, {big('sum(quantity)')} AS total_items, "
    f"{total()} AS total_sales, {mean_2()} AS average_order_value FROM {GAPPY} WHERE customer_id IS NOT NULL "
    "GROUP BY ALL", "order_ev"))
def _(spark, root):
    joined = J.join_orders_customers(gappy_orders(spark, root), R.dim_customer(spark, root))
    return J.create_customer_sales_summary(joined)


# ---- products and categories ---------------------------------------------------
OTHER_TYPES = "category_id NOT IN ('PROMO', 'ECONOMY')"


def some_categories(spark, root):
    """Categories of which two have keys that no product has, plus one that is new."""
    cats = rekeyed(R.dim_category(spark, root), "category_id", ~F.col("category_id").isin("PROMO", "ECONOMY"))
    extra = cats.groupBy().agg(
        F.lit(0).cast("bigint").alias("category_sk"), F.lit("UNUSED").alias("category_id"),
        F.lit("Unused").alias("name"), F.first("description").alias("description"),
        F.first("parent_category_id").alias("parent_category_id"),
    )
    return cats.unionByName(extra, allowMissingColumns=True)


CATS = (
    f"(SELECT category_id, name FROM {rekeyed_sql('dcat', 'category_id', OTHER_TYPES)} "
    "UNION ALL SELECT 'UNUSED', 'Unused')"
)

for kind, sql_kind in (("left", "LEFT"), ("inner", "INNER"), ("right", "RIGHT"), ("full_outer", "FULL")):

    @query(f"jn9_products_categories_{kind.split('_')[0]}", with_ctes(
        f"SELECT coalesce(p.category_id, c.category_id) AS category_id, p.product_id, c.name AS category_name "
        f"FROM dprod p {sql_kind} JOIN {CATS} c ON p.category_id = c.category_id", "dprod", "dcat"))
    def _(spark, root, kind=kind):
        joined = J.join_products_categories(R.dim_product(spark, root), some_categories(spark, root), kind)
        return joined.select("category_id", "product_id", "category_name")


@query("jn10_category_columns", with_ctes(
    "SELECT category_id, name AS category_name, 'products of type ' || category_id AS category_description "
    "FROM dcat", "dcat"))
def _(spark, root):
    prepared = J.prepare_category_columns(R.dim_category(spark, root))
    return prepared.select("category_id", "category_name", "category_description")


@query("jn11_products_categories_alias", with_ctes(
    f"SELECT p.product_id, p.name AS product_name, c.name AS category_name FROM dprod p "
    f"LEFT JOIN {CATS} c ON p.category_id = c.category_id", "dprod", "dcat"))
def _(spark, root):
    joined = J.join_with_category_alias(R.dim_product(spark, root), some_categories(spark, root))
    return joined.select(
        "product.product_id", F.col("product.name").alias("product_name"),
        F.col("category.name").alias("category_name"),
    )


@query("jn12_products_without_category", with_ctes(
    f"SELECT product_id, category_id FROM dprod WHERE category_id NOT IN (SELECT category_id FROM {CATS})",
    "dprod", "dcat"))
def _(spark, root):
    out = J.find_products_without_category(R.dim_product(spark, root), some_categories(spark, root))
    return out.select("product_id", "category_id")


@query("jn13_categories_without_products", with_ctes(
    f"SELECT category_id, name FROM {CATS} WHERE category_id NOT IN (SELECT category_id FROM dprod)",
    "dprod", "dcat"))
def _(spark, root):
    out = J.find_categories_without_products(R.dim_product(spark, root), some_categories(spark, root))
    return out.select("category_id", "name")


@query("jn14_products_per_category", with_ctes(
    "SELECT category_id, count(*) AS product_count FROM dprod GROUP BY ALL", "dprod"))
def _(spark, root):
    return J.create_category_product_summary(
        R.dim_product(spark, root), some_categories(spark, root), ordered=False
    )


# ---- sales and deliveries --------------------------------------------------------
def failed_or_moving(spark, root):
    """Transformed deliveries with a late marker; the pending ones belong to orders without a sale."""
    out = rekeyed(D.transform(R.delivery_events(spark, root)), "order_id", F.col("status") != "pending")
    return out.withColumn("late", F.col("is_late_delivery") == 1)


def with_orphans(spark, root):
    """Order events of which the small ones belong to orders without a delivery."""
    return rekeyed(R.order_events(spark, root), "order_id", F.col("quantity") > 10, "y-")


DELAY = "(epoch(event_timestamp) - epoch(estimated_delivery)) / 3600.0"
NOT_PENDING = "status <> 'pending'"
MOVED = f"(SELECT *, {DELAY} AS delay FROM {rekeyed_sql('delivery_ev', 'order_id', NOT_PENDING)})"
PART_SALES = rekeyed_sql("order_ev", "order_id", "quantity > 10", "y-")

for kind, sql_kind in (("left", "LEFT"), ("inner", "INNER"), ("right", "RIGHT"), ("full", "FULL")):

    @query(f"jn15_sales_deliveries_{kind}", with_ctes(
        f"SELECT coalesce(s.order_id, d.order_id) AS order_id, s.event_id, d.delivery_id, "
        f"d.status AS delivery_status, {amount('s.total_cents')} AS total_amount "
        f"FROM {PART_SALES} s {sql_kind} JOIN {MOVED} d "
        "ON s.order_id = d.order_id", "order_ev", "delivery_ev"))
    def _(spark, root, kind=kind):
        sales = typed_view(with_orphans(spark, root), "order")
        moving = typed_view(failed_or_moving(spark, root), "delivery")
        joined = J.join_sales_deliveries(sales, moving, kind)
        return joined.select("order_id", "event_id", "delivery_id", "delivery_status", "total_amount")


@query("jn16_delivery_columns", with_ctes(
    "SELECT order_id, delivery_id, status AS delivery_status, carrier AS delivery_carrier, "
    "event_id AS delivery_event_id FROM delivery_ev", "delivery_ev"))
def _(spark, root):
    prepared = J.prepare_delivery_columns(R.delivery_events(spark, root))
    return prepared.select(
        "order_id", "delivery_id", "delivery_status", "delivery_carrier", "delivery_event_id"
    )


@query("jn17_sales_deliveries_alias", with_ctes(
    f"SELECT s.event_id, d.delivery_id, d.status FROM order_ev s LEFT JOIN {MOVED} d "
    "ON s.order_id = d.order_id", "order_ev", "delivery_ev"))
def _(spark, root):
    joined = J.join_with_alias(R.order_events(spark, root), failed_or_moving(spark, root))
    return joined.select("sales.event_id", "delivery.delivery_id", "delivery.status")


FAILED = "status = 'failed'"


@query("jn18_sales_without_delivery", with_ctes(
    f"SELECT event_id, order_id FROM order_ev WHERE order_id NOT IN "
    f"(SELECT order_id FROM {rekeyed_sql('delivery_ev', 'order_id', FAILED)})", "order_ev", "delivery_ev"))
def _(spark, root):
    failed = rekeyed(R.delivery_events(spark, root), "order_id", F.col("status") == "failed")
    return J.find_sales_without_delivery(R.order_events(spark, root), failed).select("event_id", "order_id")


@query("jn19_deliveries_without_sale", with_ctes(
    "SELECT event_id, order_id FROM delivery_ev WHERE order_id NOT IN "
    f"(SELECT order_id FROM {rekeyed_sql('order_ev', 'order_id', 'quantity > 40')})", "order_ev", "delivery_ev"))
def _(spark, root):
    bulky = rekeyed(R.order_events(spark, root), "order_id", F.col("quantity") > 40)
    out = J.find_deliveries_without_sale(bulky, R.delivery_events(spark, root))
    return out.select("event_id", "order_id")


PAIRS = f"FROM order_ev s LEFT JOIN {MOVED} d ON s.order_id = d.order_id"


@query("jn20_logistics_sales_summary", with_ctes(
    f"SELECT d.status AS delivery_status, count(*) AS sales_count, {total('s.total_cents')} AS "
    f"total_sales_amount, {mean('s.total_cents')} AS average_sale_amount {PAIRS} GROUP BY ALL",
    "order_ev", "delivery_ev"))
def _(spark, root):
    return J.create_logistics_sales_summary(
        R.order_events(spark, root), failed_or_moving(spark, root), ordered=False
    )


@query("jn21_delivery_performance_summary", with_ctes(
    f"SELECT count(*) AS total_sales, {total('s.total_cents')} AS total_sales_amount, "
    "count(*) FILTER (d.delay > 24) AS late_delivery_count, "
    f"avg(d.delay) AS average_delivery_delay_hours {PAIRS}", "order_ev", "delivery_ev"))
def _(spark, root):
    return J.create_delivery_performance_summary(
        R.order_events(spark, root), failed_or_moving(spark, root)
    )
