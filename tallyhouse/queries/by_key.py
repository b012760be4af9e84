"""Key/value aggregates and grouping of event rows by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import refine
from ..operators import windows as W
from ..operators.aggregates import bykey as B
from ..sources import relational as R
from .base import amount, big, dbl, query, with_ctes
from .scans import rough_events


def typeless(spark, root):
    """All events; large quantities lost their type."""
    return R.all_events(spark, root).withColumn(
        "event_type", F.when(F.coalesce(F.col("quantity"), F.lit(0)) <= 40, F.col("event_type"))
    )


TYPELESS = "(SELECT * REPLACE (CASE WHEN coalesce(quantity, 0) <= 40 THEN event_type END AS event_type) FROM all_ev)"
KEYED = f"FROM {TYPELESS} WHERE event_type IS NOT NULL GROUP BY ALL"
MONEY_0 = amount("CAST(sum(coalesce(total_cents, 0)) AS BIGINT)")


@query("ar1_key_by_type", with_ctes(
    f"SELECT event_type AS key, event_id FROM {TYPELESS} WHERE event_type IS NOT NULL", "all_ev"))
def _(spark, root):
    return B.key_by(typeless(spark, root)).select("key", "event_id")


@query("ar2_count_by_key", with_ctes(f"SELECT event_type AS key, count(*) AS count {KEYED}", "all_ev"))
def _(spark, root):
    return B.count_by_key(typeless(spark, root))


@query("ar3_sum_by_key", with_ctes(f"SELECT event_type AS key, {big('sum(quantity)')} AS total {KEYED}", "all_ev"))
def _(spark, root):
    return B.sum_by_key(typeless(spark, root), "quantity")


@query("ar4_aggregate_sum", with_ctes(
    "SELECT CAST(event_timestamp AS DATE) AS key, "
    f"{dbl('sum(coalesce(quantity * 2, 0))')} AS total FROM all_ev GROUP BY ALL", "all_ev"))
def _(spark, root):
    return B.aggregate_sum(
        R.all_events(spark, root), F.to_date("event_timestamp"), F.col("quantity") * 2
    )


@query("ar5_quantity_by_type", with_ctes(
    f"SELECT event_type AS key, {dbl('sum(coalesce(quantity, 0))')} AS total {KEYED}", "all_ev"))
def _(spark, root):
    return B.aggregate_quantity(typeless(spark, root))


@query("ar6_revenue_by_type", with_ctes(f"SELECT event_type AS key, {MONEY_0} AS total {KEYED}", "all_ev"))
def _(spark, root):
    return B.aggregate_revenue_by_event_type(typeless(spark, root))


@query("ar7_average_by_key", with_ctes(
    "SELECT customer_id AS key, CASE WHEN count(total_cents) = 0 THEN 0.0 ELSE "
    f"{amount('CAST(sum(total_cents) AS BIGINT)')} / count(total_cents) END AS average FROM all_ev GROUP BY ALL",
    "all_ev"))
def _(spark, root):
    return B.average_by_key(R.all_events(spark, root), "total_amount", "customer_id")


@query("ar8_sales_metrics", with_ctes(
    f"SELECT event_type AS key, count(*) AS event_count, {dbl('sum(coalesce(quantity, 0))')} AS "
    f"total_quantity, {MONEY_0} AS total_revenue, {MONEY_0} / count(*) AS average_revenue {KEYED}", "all_ev"))
def _(spark, root):
    return B.calculate_sales_metrics(typeless(spark, root))


@query("ar9_top_keys", with_ctes(
    "SELECT product_id AS key, sum(quantity)::BIGINT AS total FROM order_ev GROUP BY ALL "
    "ORDER BY total DESC, key LIMIT 10", "order_ev"))
def _(spark, root):
    return B.top_keys(B.sum_by_key(R.order_events(spark, root), "quantity", "product_id"))


@query("ar10_repartition_by_key", with_ctes(f"SELECT event_type AS key, count(*) AS n {KEYED}", "all_ev"))
def _(spark, root):
    spread = B.repartition_by_key(B.key_by(typeless(spark, root)), 16)
    return spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


for name, column, cte in (
    ("kb2_by_customer", "customer_id", "all_ev"),
    ("kb3_by_product", "product_id", "order_ev"),
    ("kb4_by_type", "event_type", "all_ev"),
    ("kb5_by_order", "order_id", "order_ev"),
):

    @query(name, with_ctes(
        f"SELECT {column} AS key, count(*) AS n FROM {cte} GROUP BY ALL", cte))
    def _(spark, root, column=column, cte=cte):
        source = R.all_events if cte == "all_ev" else R.order_events
        rows = B.key_by(source(spark, root), column)
        return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("kb6_keyed_rows", with_ctes("SELECT customer_id AS key, event_id, event_type FROM all_ev", "all_ev"))
def _(spark, root):
    return B.key_by(R.all_events(spark, root), "customer_id").select("key", "event_id", "event_type")


# ---- whole-frame and keyed aggregates of a stream's rows --------------------------
KIND = "CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'mixed' END"
SPAN = (
    "min(event_timestamp) AS window_start, max(event_timestamp) AS window_end, "
    f"{KIND} AS event_type, count(*) AS event_count, count(DISTINCT customer_id) AS unique_customers, "
    f"{big('sum(coalesce(quantity, 0))')} AS total_quantity, {MONEY_0} AS total_amount, "
    "string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types"
)


@query("sa1_aggregate_all", with_ctes(f"SELECT {SPAN}, CAST(NULL AS VARCHAR) AS key FROM all_ev", "all_ev"))
def _(spark, root):
    return W.aggregate_events(R.all_events(spark, root))


for name, column in (
    ("sa2_aggregate_by_type", "event_type"),
    ("sa3_aggregate_by_customer", "customer_id"),
    ("sa4_aggregate_by_product", "product_id"),
    ("sa5_aggregate_by_status", "status"),
):

    @query(name, with_ctes(
        f"SELECT {column} AS key, {SPAN} FROM all_ev a WHERE {column} IS NOT NULL GROUP BY {column}"
        .replace("min(event_type)", "min(a.event_type)"), "all_ev"))
    def _(spark, root, column=column):
        return W.aggregate_events(R.all_events(spark, root), column)


@query("sa6_total_value", with_ctes(f"SELECT {MONEY_0} AS total_value FROM all_ev", "all_ev"))
def _(spark, root):
    return W.total_value(R.all_events(spark, root))


@query("sa7_event_count", with_ctes("SELECT count(*) AS event_count FROM all_ev", "all_ev"))
def _(spark, root):
    return W.count_events(R.all_events(spark, root))


@query("sa8_unique_customers", with_ctes("SELECT count(DISTINCT customer_id) AS unique_customers FROM rough_ev", "rough_ev"))
def _(spark, root):
    return W.count_unique_customers(refine.normalize_columns(rough_events(spark, root)))


@query("sa9_average_ticket", with_ctes(
    "SELECT CAST((2 * sum(total_cents) + count(total_cents)) // (2 * count(total_cents)) AS DOUBLE) / 100 "
    "AS average_ticket FROM all_ev", "all_ev"))
def _(spark, root):
    return W.average_ticket(R.all_events(spark, root))
