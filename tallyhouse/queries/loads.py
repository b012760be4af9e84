"""Loads that are audited and published as a whole, and marts that follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.skew import find_heavy_keys
from ..plans import copartition
from ..plans.copartition import Layout
from ..plans.incremental import IncrementalMart
from ..session import scratch
from ..sinks.published import AuditFailed, Published
from ..sources import relational as R
from .base import amount, big, query, total, with_ctes

#: The three increments end before these months; the reload brings the months of the last pair again.
CUTS, AGAIN = ("1994-01", "1996-01"), ("1995-02", "1995-08")


def orders(spark, root):
    return R.order_events(spark, root).withColumn("month", F.date_format("event_timestamp", "yyyy-MM"))


def between(df, low, high):
    df = df if low is None else df.filter(F.col("month") >= low)
    return df if high is None else df.filter(F.col("month") < high)


def sales_rules():
    return {"an amount above zero": F.col("total_amount") > 0, "a customer": F.col("customer_id").isNotNull()}

PER_MONTH = (
    f"SELECT strftime(event_timestamp, '%Y-%m') AS month, count(*) AS orders, {big('sum(quantity)')} AS items, "
    f"{total()} AS amount FROM order_ev"
)


@query("snk9_audited_publish", with_ctes(
    f"SELECT 'failed audit' AS after, * FROM ({PER_MONTH} GROUP BY 1) "
    f"UNION ALL SELECT 'reload' AS after, * FROM ({PER_MONTH} WHERE NOT (quantity = 13 AND strftime(event_timestamp, '%Y-%m') >= '{AGAIN[0]}' "
    f"AND strftime(event_timestamp, '%Y-%m') < '{AGAIN[1]}') GROUP BY 1) "
    f"UNION ALL SELECT 'rollback' AS after, * FROM ({PER_MONTH} GROUP BY 1)", "order_ev"))
def _(spark, root):
    """A first load, a reload of some months that fails its audit, one that passes, and the way back.

    Readers of the view see the first load after the failed one, and again after the rollback.
    """
    store = Published(spark, scratch(spark, "published"))
    name = "sales_" + store.path.rsplit("-", 1)[1]
    sales = orders(spark, root)
    first = store.load("sales", sales, "month", sales_rules())
    store.view(name, "sales")
    again = between(sales, *AGAIN)
    spoiled = again.withColumn("total_amount", F.when(F.col("quantity") != 13, F.col("total_amount")))
    try:
        store.load("sales", spoiled, "month", sales_rules())
    except AuditFailed:
        pass  # nothing of it is visible

    def seen(df, after):
        sums = [F.count(F.lit(1)).alias("orders"), F.sum("quantity").alias("items"), F.sum("total_amount").cast("double").alias("amount")]
        return df.groupBy("month").agg(*sums).select(F.lit(after).alias("after"), "*")

    out = seen(spark.table(name), "failed audit")
    spark.sql(f"DROP VIEW {name}")
    version = store.load("sales", again.filter("quantity <> 13"), "month", sales_rules())
    out = out.unionByName(seen(store.read("sales", store.manifest(version)), "reload"))
    return out.unionByName(seen(store.read("sales", store.manifest(store.rollback(first))), "rollback"))


def product_mart(spark):
    return IncrementalMart(
        Published(spark, scratch(spark, "mart")),
        "product_sales",
        keys=["product_id", "status"],
        # money in whole cents: a decimal of the width of its sum is three times as wide in a shuffle
        sums={"total_quantity": F.col("quantity").cast("long"), "total_revenue": (F.col("total_amount") * 100).cast("long")},
        distinct={"unique_orders": F.col("order_id"), "unique_customers": F.col("customer_id")},
        by="month",
    )


#: What a row of the mart's loads needs.
SOLD = ("month", "product_id", "status", "order_id", "customer_id", "quantity", "total_amount")


def landed_sales(spark, root):
    """The sales as they arrive: lines and orders are joined once, and every load reads the stored rows."""
    path, sales = scratch(spark, "landed"), orders(spark, root).select(*SOLD)
    sales.write.parquet(path)
    return spark.read.schema(sales.schema).parquet(path)


def loaded_mart(spark, root):
    """Three increments, of which the second brings some months wrong, and a reload of those months."""
    mart, sales = product_mart(spark), landed_sales(spark, root)
    wrong = (F.col("month") >= AGAIN[0]) & (F.col("month") < AGAIN[1])
    spoiled = sales.withColumns({
        "quantity": F.when(wrong, F.col("quantity") + 1).otherwise(F.col("quantity")),
        "customer_id": F.when(wrong, F.concat(F.lit("wrong-"), "order_id")).otherwise(F.col("customer_id"))})
    spoiled = spoiled.filter(~wrong | (F.col("status") != "processing"))
    # the landed files are few and large, so a task writes its rows of a month where they are
    for low, high in zip((None, *CUTS), (*CUTS, None)):
        mart.apply(between(spoiled, low, high), gather=False)
    mart.apply(between(sales, *AGAIN), gather=False)
    return mart


def in_money(mart):
    return mart.withColumn("total_revenue", (F.col("total_revenue") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(24,2)"))


MART_SQL = (
    f"count(*) AS row_count, {big('sum(quantity)')} AS total_quantity, {total()} AS total_revenue, "
    "count(DISTINCT order_id) AS unique_orders, count(DISTINCT customer_id) AS unique_customers FROM order_ev"
)


@query("snk26_incremental_mart", with_ctes(f"SELECT product_id, status, {MART_SQL} GROUP BY 1, 2", "order_ev"))
def _(spark, root):
    """What the loads have left equals a full recomputation."""
    mart = loaded_mart(spark, root)
    mart.fold()
    return in_money(mart.read())


@query("snk26_incremental_by_month", with_ctes(
    f"SELECT strftime(event_timestamp, '%Y-%m') AS month, product_id, status, {MART_SQL} GROUP BY 1, 2, 3", "order_ev"))
def _(spark, root):
    return in_money(loaded_mart(spark, root).read_by_partition())


# ---- tables stored for joins without a shuffle -------------------------------------
def stored(spark, path, layout, **frames):
    names = {}
    for name, df in frames.items():
        names[name] = f"{name}_{path.rsplit('-', 1)[1]}"
        copartition.store(df, layout, names[name], path=path)
    return names


def dropped(spark, names):
    """The tables are external, so a frame that was made from them still reads their files."""
    for name in names.values():
        copartition.drop(spark, name)


def line_buckets(spark, root):
    return copartition.buckets_for(R.table(spark, root, "lineitem").count())


def sales_and_deliveries(spark, root, how="left"):
    sales = R.order_events(spark, root).select("order_id", "event_id", "product_id", "total_amount")
    moved = R.delivery_events(spark, root).filter("status <> 'pending'").select("order_id", "delivery_id", "carrier")
    layout = Layout("order_id", line_buckets(spark, root), find_heavy_keys(sales, "order_id"))
    names = stored(spark, scratch(spark, "by_order"), layout, sales=sales, moved=moved)
    out = copartition.join(spark, names["sales"], names["moved"], layout, how)
    dropped(spark, names)
    return out


@query("ddl3_copartitioned_sales_delivery", with_ctes(
    f"SELECT s.order_id, s.event_id, s.product_id, {amount('s.total_cents')} AS total_amount, d.delivery_id, d.carrier "
    "FROM order_ev s LEFT JOIN (SELECT * FROM delivery_ev WHERE status <> 'pending') d ON s.order_id = d.order_id",
    "order_ev", "delivery_ev"))
def _(spark, root):
    return sales_and_deliveries(spark, root)


def customers_and_sales(spark, root):
    """Sales per customer next to the customer: both steps stay inside the buckets of the customer."""
    sales = R.order_events(spark, root).select("customer_id", "order_id", "quantity", "total_amount")
    layout = Layout("customer_id", line_buckets(spark, root), find_heavy_keys(sales, "customer_id"))
    people = R.dim_customer(spark, root).select("customer_id", "name", "segment")
    names = stored(spark, scratch(spark, "by_customer"), layout, people=people, sales=sales)
    joined = copartition.join(spark, names["people"], names["sales"], layout, "left")
    dropped(spark, names)
    return joined.groupBy("customer_id", "name", "segment").agg(
        F.count("order_id").alias("sales"), F.count_distinct("order_id").alias("orders"),
        F.sum("quantity").alias("items"), F.sum("total_amount").alias("amount"))


@query("ddl3_copartitioned_customers", with_ctes(
    "SELECT c.customer_id, c.name, c.segment, count(s.order_id) AS sales, count(DISTINCT s.order_id) AS orders, "
    f"{big('sum(s.quantity)')} AS items, {total('s.total_cents')} AS amount "
    "FROM dcust c LEFT JOIN order_ev s ON s.customer_id = c.customer_id GROUP BY ALL", "order_ev", "dcust"))
def _(spark, root):
    return customers_and_sales(spark, root)
