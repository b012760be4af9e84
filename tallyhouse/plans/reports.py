"""Report queries over the star schema and over raw events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import count_when
from ..schemas import COMPLETED_STATUSES, REQUIRED_FIELDS
from .views import completed, total, with_product


def mean_2(column: str):
    return F.round(F.try_divide(F.sum(column), F.count(column)), 2).cast("double")


def overview(sales: DataFrame, statuses=COMPLETED_STATUSES) -> DataFrame:
    return completed(sales, statuses).agg(
        F.count(F.lit(1)).alias("total_sales"),
        F.count_distinct("order_id").alias("total_orders"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.sum("quantity").alias("total_items"),
        total("total_amount").alias("gross_revenue"),
        mean_2("total_amount").alias("average_order_value"),
    )


def daily_sales(sales: DataFrame, ordered: bool = True, statuses=COMPLETED_STATUSES) -> DataFrame:
    out = completed(sales, statuses).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("total_sales"),
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("quantity").alias("total_items"),
        total("total_amount").alias("revenue"),
    )
    return out.orderBy("event_date") if ordered else out


def _per_product(sales: DataFrame, statuses) -> DataFrame:
    return completed(sales, statuses).groupBy("product_id").agg(
        F.sum("quantity").alias("total_quantity"),
        F.count_distinct("order_id").alias("total_orders"),
        total("total_amount").alias("total_revenue"),
    )


def top_products_by_revenue(
    sales: DataFrame, products: DataFrame, categories: DataFrame, limit: int = 20, statuses=COMPLETED_STATUSES
) -> DataFrame:
    """Top-k with names; ties by product. Names are looked up for the k winners only."""
    best = (
        _per_product(sales, statuses).orderBy(F.desc("total_revenue"), "product_id").limit(limit)
    )
    return with_product(best, products, categories)


def revenue_by_category(
    sales: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    ordered: bool = True,
    statuses=COMPLETED_STATUSES,
) -> DataFrame:
    """Sales per category; unknown products and categories stay under a null category."""
    named = products.select("product_id", "category_id")
    kinds = categories.select(
        F.col("category_id"), F.col("category_id").alias("_known"), F.col("name").alias("category_name")
    )
    # one row per product and order before anything is joined: a few categories are no key to deal by
    sold = completed(sales, statuses).groupBy("product_id", "order_id").agg(
        F.sum("quantity").alias("quantity"), F.sum("total_amount").alias("total_amount")
    )
    joined = sold.join(named, "product_id", "left").join(kinds, "category_id", "left")
    out = joined.groupBy(F.col("_known").alias("category_id"), "category_name").agg(
        F.sum("quantity").alias("total_items"),
        F.count_distinct("order_id").alias("total_orders"),
        total("total_amount").alias("total_revenue"),
    )
    return out.orderBy(F.desc("total_revenue")) if ordered else out


def top_customers_by_spend(
    sales: DataFrame, customers: DataFrame, limit: int = 20, statuses=COMPLETED_STATUSES
) -> DataFrame:
    best = (
        completed(sales, statuses)
        .groupBy("customer_id")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.sum("quantity").alias("total_items"),
            total("total_amount").alias("total_spent"),
            mean_2("total_amount").alias("average_order_value"),
        )
        .orderBy(F.desc("total_spent"), "customer_id")
        .limit(limit)
    )
    named = customers.select("customer_id", F.col("name").alias("customer_name"), "segment")
    return best.join(named, "customer_id", "left")


def average_ticket_by_day(sales: DataFrame, ordered: bool = True, statuses=COMPLETED_STATUSES) -> DataFrame:
    out = completed(sales, statuses).groupBy("event_date").agg(
        mean_2("total_amount").alias("average_order_value"),
        F.count_distinct("order_id").alias("total_orders"),
    )
    return out.orderBy("event_date") if ordered else out


def top_products_by_quantity(
    sales: DataFrame, products: DataFrame, limit: int = 20, statuses=COMPLETED_STATUSES
) -> DataFrame:
    best = (
        _per_product(sales, statuses)
        .select("product_id", "total_quantity", "total_revenue")
        .orderBy(F.desc("total_quantity"), "product_id")
        .limit(limit)
    )
    named = products.select("product_id", F.col("name").alias("product_name"))
    return best.join(named, "product_id", "left")


def events_by_type(events: DataFrame, ordered: bool = True) -> DataFrame:
    out = (
        events.filter(F.col("event_type").isNotNull())
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("total_events"))
    )
    return out.orderBy(F.desc("total_events")) if ordered else out


def events_by_date_and_hour(events: DataFrame, ordered: bool = True) -> DataFrame:
    """Rows without a readable time fall out."""
    ts = F.try_to_timestamp(F.col("event_timestamp"))
    out = (
        events.select(F.to_date(ts).alias("event_date"), F.hour(ts).alias("event_hour"))
        .filter(F.col("event_date").isNotNull())
        .groupBy("event_date", "event_hour")
        .agg(F.count(F.lit(1)).alias("total_events"))
    )
    return out.orderBy("event_date", "event_hour") if ordered else out


def missing_required_fields(events: DataFrame) -> list[str]:
    return sorted(set(REQUIRED_FIELDS) - set(events.columns))


def required_field_gaps(events: DataFrame) -> DataFrame:
    """One row per required field: is the column absent, and how many rows lack it."""
    absent = set(missing_required_fields(events))
    gaps = [
        (F.count(F.lit(1)) if f in absent else count_when(F.col(f).isNull())).alias(f)
        for f in REQUIRED_FIELDS
    ]
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.lit(f in absent).alias("column_absent"),
                F.col(f).alias("rows_without_value"),
            )
            for f in REQUIRED_FIELDS
        ]
    )
    return events.agg(*gaps).select(F.inline(pairs))


def fact_row_counts(facts: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("total_records")).select(
            F.lit(name).alias("table_name"), "total_records"
        )
        for name, df in facts.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def count_by_event_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
