"""Enrichment and orphan joins between events and their related tables.

Three families share two building blocks: ``enrich`` (prefix the right columns,
join USING the key so it appears once) and ``orphans`` (anti join).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import MONEY, mean_money_2, require, sum_money
from .skew import DEFAULT, NO_SKEW, HeavyKeys, SkewPolicy, balanced_join

ORDER_CUSTOMER_TYPES = ("inner", "left", "right", "outer", "left_semi", "left_anti")
ENRICH_TYPES = ("inner", "left", "right", "full", "left_outer", "right_outer", "full_outer")

# --- fixed values: customer columns renamed because orders have them too ---
COLLIDING = (
    "event_id",
    "event_type",
    "event_timestamp",
    "ingestion_timestamp",
    "session_id",
    "product_id",
    "order_id",
    "cart_id",
    "delivery_id",
    "quantity",
    "unit_price",
    "total_amount",
    "status",
)
# --- end of fixed values ---


def prefix_columns(df: DataFrame, prefix: str, keep: str, wanted: Callable[[str], bool]) -> DataFrame:
    """Prefix the wanted columns, except the key and those already prefixed."""
    return df.select(
        *[
            F.col(c).alias(f"{prefix}{c}")
            if c != keep and not c.startswith(prefix) and wanted(c)
            else F.col(c)
            for c in df.columns
        ]
    )


def _same_key(right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return right if left_key == right_key else right.withColumnRenamed(right_key, left_key)


def enrich(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str,
    allowed: tuple[str, ...],
    heavy: HeavyKeys = NO_SKEW,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    if how not in allowed:
        raise ValueError(f"join type {how!r} is not one of {sorted(allowed)}")
    require(left, left_key)
    require(right, right_key)
    right = _same_key(right, left_key, right_key)
    twice = sorted(set(left.columns) & set(right.columns) - {left_key})
    if twice and how not in ("left_semi", "left_anti"):
        raise ValueError(
            f"columns on both sides: {twice}; narrow one side first, for instance with typed_view"
        )
    return balanced_join(left, right, left_key, how, heavy, policy)


def orphans(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    heavy: HeavyKeys = NO_SKEW,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Left rows whose key is not on the right (null keys included).

    The right side shrinks to its distinct keys before it moves, so a key with
    very many right rows costs one row per task.
    """
    require(left, left_key)
    require(right, right_key)
    keys = right.select(F.col(right_key).alias(left_key)).filter(F.col(left_key).isNotNull())
    return balanced_join(left, keys.distinct(), left_key, "left_anti", heavy, policy).select(
        *left.columns
    )


# ---- orders and customers -----------------------------------------------
def filter_valid_orders(orders: DataFrame, key: str = "customer_id") -> DataFrame:
    return orders.filter(F.col(key).isNotNull())


def filter_valid_customers(customers: DataFrame, key: str = "customer_id") -> DataFrame:
    return customers.filter(F.col(key).isNotNull())


def prepare_customer_columns(
    customers: DataFrame, key: str = "customer_id", orders: DataFrame | None = None
) -> DataFrame:
    """Prefix the columns orders usually have, and those the given orders do have."""
    taken = set(COLLIDING) | set(orders.columns if orders is not None else ())
    return prefix_columns(customers, "customer_", key, lambda c: c in taken)


def join_orders_customers(
    orders: DataFrame,
    customers: DataFrame,
    how: str = "left",
    order_key: str = "customer_id",
    customer_key: str = "customer_id",
    **skew,
) -> DataFrame:
    """Orders with their customer; rows without a key are left out on both sides."""
    return enrich(
        filter_valid_orders(orders, order_key),
        prepare_customer_columns(
            filter_valid_customers(customers, customer_key), customer_key, orders
        ),
        order_key,
        customer_key,
        how,
        ORDER_CUSTOMER_TYPES,
        **skew,
    )


def _aliased(left, right, left_name, right_name, left_key, right_key, how) -> DataFrame:
    condition = F.col(f"{left_name}.{left_key}") == F.col(f"{right_name}.{right_key}")
    return left.alias(left_name).join(right.alias(right_name), condition, how)


def join_with_customer_alias(
    orders: DataFrame,
    customers: DataFrame,
    how: str = "left",
    order_key: str = "customer_id",
    customer_key: str = "customer_id",
) -> DataFrame:
    """Both sides keep all columns, addressed as ``orders.*`` and ``customers.*``."""
    return _aliased(orders, customers, "orders", "customers", order_key, customer_key, how)


def find_orders_without_customer(
    orders: DataFrame, customers: DataFrame, key: str = "customer_id", **skew
) -> DataFrame:
    return orphans(filter_valid_orders(orders, key), customers, key, key, **skew)


def find_customers_without_orders(
    orders: DataFrame, customers: DataFrame, key: str = "customer_id", **skew
) -> DataFrame:
    return orphans(filter_valid_customers(customers, key), orders, key, key, **skew)


def create_customer_sales_summary(joined: DataFrame) -> DataFrame:
    require(joined, "customer_id")
    measures = [F.count(F.lit(1)).alias("order_count")]
    if "quantity" in joined.columns:
        measures.append(F.sum(F.col("quantity").cast("long")).alias("total_items"))
    if "total_amount" in joined.columns:
        measures.append(sum_money("total_amount").alias("total_sales"))
        measures.append(mean_money_2("total_amount").alias("average_order_value"))
    return joined.groupBy("customer_id").agg(*measures)


# ---- products and categories --------------------------------------------
def prepare_category_columns(categories: DataFrame, key: str = "category_id") -> DataFrame:
    return prefix_columns(categories, "category_", key, lambda _c: True)


def join_products_categories(
    products: DataFrame,
    categories: DataFrame,
    how: str = "left",
    product_key: str = "category_id",
    category_key: str = "category_id",
    **skew,
) -> DataFrame:
    """Products with their category. Spark broadcasts the categories when its size
    estimate is below ``spark.sql.autoBroadcastJoinThreshold``; no hint is forced."""
    prepared = prepare_category_columns(categories, category_key)
    return enrich(products, prepared, product_key, category_key, how, ENRICH_TYPES, **skew)


def join_with_category_alias(
    products: DataFrame,
    categories: DataFrame,
    how: str = "left",
    product_key: str = "category_id",
    category_key: str = "category_id",
) -> DataFrame:
    return _aliased(products, categories, "product", "category", product_key, category_key, how)


def find_products_without_category(
    products: DataFrame, categories: DataFrame, key: str = "category_id", **skew
) -> DataFrame:
    return orphans(products, categories, key, key, **skew)


def find_categories_without_products(
    products: DataFrame, categories: DataFrame, key: str = "category_id", **skew
) -> DataFrame:
    return orphans(categories, products, key, key, **skew)


def create_category_product_summary(
    products: DataFrame, categories: DataFrame, how: str = "left", ordered: bool = True, **skew
) -> DataFrame:
    joined = join_products_categories(products, categories, how, **skew)
    out = joined.groupBy("category_id").agg(F.count(F.lit(1)).alias("product_count"))
    return out.orderBy(F.desc("product_count")) if ordered else out


# ---- sales and deliveries -----------------------------------------------
def prepare_delivery_columns(deliveries: DataFrame, key: str = "order_id") -> DataFrame:
    return prefix_columns(deliveries, "delivery_", key, lambda _c: True)


def join_sales_deliveries(
    sales: DataFrame,
    deliveries: DataFrame,
    how: str = "left",
    sales_key: str = "order_id",
    delivery_key: str = "order_id",
    **skew,
) -> DataFrame:
    """Every sale row with every delivery row of its order (fan-out is the result)."""
    prepared = prepare_delivery_columns(deliveries, delivery_key)
    return enrich(sales, prepared, sales_key, delivery_key, how, ENRICH_TYPES, **skew)


def join_with_alias(
    sales: DataFrame,
    deliveries: DataFrame,
    how: str = "left",
    sales_key: str = "order_id",
    delivery_key: str = "order_id",
) -> DataFrame:
    return _aliased(sales, deliveries, "sales", "delivery", sales_key, delivery_key, how)


def find_sales_without_delivery(
    sales: DataFrame, deliveries: DataFrame, key: str = "order_id", **skew
) -> DataFrame:
    return orphans(sales, deliveries, key, key, **skew)


def find_deliveries_without_sale(
    sales: DataFrame, deliveries: DataFrame, key: str = "order_id", **skew
) -> DataFrame:
    return orphans(deliveries, sales, key, key, **skew)


def _sales_per_order(sales: DataFrame, key: str) -> DataFrame:
    amount = F.col("total_amount").try_cast(MONEY)
    return sales.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(amount).alias("_amounts"),
        F.sum(amount).alias("_amount"),
    )


def create_logistics_sales_summary(
    sales: DataFrame, deliveries: DataFrame, key: str = "order_id", ordered: bool = True
) -> DataFrame:
    """Sale rows per delivery status over the left join, sales without one under null.

    Both sides shrink to one row per order (and status) first. Each joined pair
    then stands for rows x rows, so the fan-out is counted, never produced.
    """
    left = _sales_per_order(sales, key)
    prepared = prepare_delivery_columns(deliveries, key).filter(F.col(key).isNotNull())
    by_status = "delivery_status" in prepared.columns
    groups = ["delivery_status"] if by_status else []
    right = prepared.groupBy(key, *groups).agg(F.count(F.lit(1)).alias("_copies"))
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    total = F.sum(F.col("_amount") * copies)
    measures = [
        F.sum(F.col("_rows") * copies).alias("sales_count"),
        total.cast("double").alias("total_sales_amount"),
    ]
    if by_status:
        mean = F.try_divide(total.cast("double"), F.sum(F.col("_amounts") * copies))
        measures.append(mean.alias("average_sale_amount"))
    out = left.join(right, on=[key], how="left").groupBy(*groups).agg(*measures)
    return out.orderBy(F.desc("sales_count")) if ordered and by_status else out


def create_delivery_performance_summary(
    sales: DataFrame, deliveries: DataFrame, key: str = "order_id"
) -> DataFrame:
    """Totals over the left join: rows, amount, late deliveries, mean delay.

    Same idea as above: counts and sums per order are multiplied, so no pair of
    rows is ever built.
    """
    left = _sales_per_order(sales, key)
    prepared = prepare_delivery_columns(deliveries, key).filter(F.col(key).isNotNull())
    has_late = "delivery_late" in prepared.columns
    has_delay = "delivery_delay_hours" in prepared.columns
    per_order = [F.count(F.lit(1)).alias("_copies")]
    if has_late:
        late = F.col("delivery_late").cast("boolean")
        per_order.append(F.count(F.when(late, F.lit(1))).alias("_late"))
    if has_delay:
        per_order.append(F.count("delivery_delay_hours").alias("_delays"))
        per_order.append(F.sum("delivery_delay_hours").alias("_delay"))
    right = prepared.groupBy(key).agg(*per_order)
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    measures = [
        F.sum(F.col("_rows") * copies).alias("total_sales"),
        F.sum(F.col("_amount") * copies).cast("double").alias("total_sales_amount"),
    ]
    if has_late:
        late_rows = F.sum(F.col("_rows") * F.coalesce(F.col("_late"), F.lit(0)))
        measures.append(late_rows.alias("late_delivery_count"))
    if has_delay:
        hours = F.sum(F.col("_rows") * F.col("_delay"))
        known = F.sum(F.col("_rows") * F.col("_delays"))
        measures.append(F.try_divide(hours, known).alias("average_delivery_delay_hours"))
    return left.join(right, on=[key], how="left").agg(*measures)
