"""Column statistics in the catalog, and the order of joins that follows from them."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import warehouse as WH


@pytest.fixture(scope="module")
def shop(spark):
    """A fact with three dimensions; brand 7 is one product in a thousand."""
    name = f"shop_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    ids = spark.range(40_000)
    ids.select(
        "id", (F.col("id") % 1000).alias("product_id"), (F.col("id") % 900).alias("customer_id"), (F.col("id") % 20).alias("store_id"),
        F.when(F.col("id") % 10 != 0, F.col("id") % 50).alias("pieces"),
    ).write.saveAsTable(f"{name}.sales")
    spark.range(1000).select(F.col("id").alias("product_id"), F.col("id").alias("brand")).write.saveAsTable(f"{name}.products")
    spark.range(900).select(F.col("id").alias("customer_id"), (F.col("id") % 3).alias("segment")).write.saveAsTable(f"{name}.customers")
    spark.range(20).select(F.col("id").alias("store_id"), (F.col("id") % 2).alias("city")).write.saveAsTable(f"{name}.stores")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def joined(spark, shop):
    return spark.sql(
        f"SELECT s.id, c.segment, t.city FROM {shop}.sales s JOIN {shop}.customers c ON s.customer_id = c.customer_id "
        f"JOIN {shop}.stores t ON s.store_id = t.store_id JOIN {shop}.products p ON s.product_id = p.product_id WHERE p.brand = 7")


def joined_first(df):
    """The dimension in the deepest join of the plan, which is the one the fact meets first."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = max((i for i, line in enumerate(lines) if line.lstrip(" :+-").startswith("Join")), key=lambda i: depth(lines[i]))
    below = [line for line in lines[at + 1:] if depth(line) > depth(lines[at])]
    tables = [t for line in below for t in ("sales", "customers", "stores", "products") if f".{t}" in line]
    (dimension,) = [t for t in tables if t != "sales"]
    return dimension


def test_statistics_change_the_order_of_three_joins(spark, shop):
    plain = sorted(joined(spark, shop).collect())
    with WH.cost_based(spark):
        before = joined_first(joined(spark, shop))
        for table in ("sales", "products", "customers", "stores"):
            WH.analyze_columns(spark, table, database=shop)
        after = joined(spark, shop)
        assert (before, joined_first(after)) == ("customers", "products")
        assert sorted(after.collect()) == plain and len(plain) == 40
    assert spark.conf.get("spark.sql.cbo.enabled") == "false"


def test_catalog_tells_ranges_nulls_and_histograms(spark, shop):
    WH.analyze_columns(spark, "sales", ["pieces"], shop)
    row = WH.column_statistics(spark, "sales", ["pieces"], shop).first()
    assert (row["num_nulls"], row["min"], row["max"], row["has_histogram"]) == ("4000", "1", "49", True)
    assert abs(int(row["distinct_count"]) - 45) <= 5


def test_what_was_not_gathered_is_null(spark, shop):
    spark.sql(f"CREATE TABLE {shop}.untold (a INT, m MAP<STRING, STRING>) USING parquet")
    row = WH.column_statistics(spark, "untold", ["a"], shop).first()
    assert row["min"] is None and not row["has_histogram"]
    WH.analyze_columns(spark, "untold", database=shop)  # an empty table; the map is left out
    assert WH.column_statistics(spark, "untold", ["a"], shop).first()["num_nulls"] == "0"
    assert not WH.column_statistics(spark, "sales", ["customer_id"], shop).first()["has_histogram"]
    with pytest.raises(ValueError):
        WH.analyze_columns(spark, "nowhere", database=shop)
    with pytest.raises(ValueError):
        WH.analyze_columns(spark, "untold", [], shop)
