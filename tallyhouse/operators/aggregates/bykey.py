"""Key/value aggregates on any event frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.basics import MONEY, as_col


def key_by(df: DataFrame, key: Column | str = "event_type") -> DataFrame:
    """Add ``key`` and drop rows without one."""
    return df.withColumn("key", as_col(key)).filter(F.col("key").isNotNull())


def count_by_key(df: DataFrame, key: str = "event_type") -> DataFrame:
    return key_by(df, key).groupBy("key").agg(F.count(F.lit(1)).alias("count"))


def sum_by_key(df: DataFrame, value: Column | str, key: Column | str = "event_type") -> DataFrame:
    """Sum of non-null values per key."""
    return key_by(df, key).groupBy("key").agg(F.sum(as_col(value)).alias("total"))


def aggregate_sum(df: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    """Sum per key where both key and value are column expressions; null adds nothing."""
    return (
        df.select(as_col(key).alias("key"), as_col(value).alias("_value"))
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.sum(F.coalesce(F.col("_value"), F.lit(0))).cast("double").alias("total"))
    )


def aggregate_quantity(df: DataFrame) -> DataFrame:
    return aggregate_sum(df, "event_type", "quantity")


def aggregate_revenue_by_event_type(df: DataFrame) -> DataFrame:
    return aggregate_sum(df, "event_type", F.col("total_amount").try_cast(MONEY))


def average_by_key(df: DataFrame, value: Column | str, key: Column | str = "event_type") -> DataFrame:
    """Mean of non-null values per key, from an exact sum when the value is decimal."""
    out = key_by(df, key).withColumn("_value", as_col(value))
    mean = F.try_divide(F.sum("_value").cast("double"), F.count("_value"))
    return out.groupBy("key").agg(F.coalesce(mean, F.lit(0.0)).alias("average"))


def calculate_sales_metrics(df: DataFrame) -> DataFrame:
    """Count, quantity, revenue and revenue per event: a null amount counts as 0 in the mean."""
    amount = F.coalesce(F.col("total_amount").try_cast(MONEY), F.lit(0).cast(MONEY))
    quantity = F.coalesce(F.col("quantity").cast("long"), F.lit(0))
    revenue = F.sum(amount).cast("double")
    return (
        key_by(df)
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.sum(quantity).cast("double").alias("total_quantity"),
            revenue.alias("total_revenue"),
            (revenue / F.count(F.lit(1))).alias("average_revenue"),
        )
    )


def top_keys(totals: DataFrame, limit: int = 10, value: str = "total", key: str = "key") -> DataFrame:
    """The k largest values; ties resolved by key. Each task keeps only k rows."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return totals.orderBy(F.desc(value), F.asc(key)).limit(limit)


def repartition_by_key(df: DataFrame, num_partitions: int, key: str = "key") -> DataFrame:
    if num_partitions < 1:
        raise ValueError("num_partitions must be positive")
    return df.repartition(num_partitions, key)


run = calculate_sales_metrics
