"""Star schema: dimensions, facts, views, reports, and catalog maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import curate, refine
from ..operators import windows as W
from ..plans import reports, views
from ..plans import warehouse as WH
from ..schemas import EVENT_TYPES
from ..session import scratch
from ..sinks import catalog
from ..sources import relational as R
from .base import amount, big, mean, mean_2, query, total, with_ctes
from .marts import DAY

DONE = "WHERE status IN ('completed', 'delivered')"


def curated(spark, root, types=EVENT_TYPES):
    return curate.curate(R.all_events(spark, root, types))


def facts(spark, root):
    events = curated(spark, root)
    return {name: WH.fact_rows(events, name) for name in WH.FACTS}


#: Event type that a fact table is made of.
TYPE_OF = dict(zip(WH.FACTS, ("order", "click", "cart", "delivery")))


def fact(name):
    return lambda spark, root: WH.fact_rows(curated(spark, root, (TYPE_OF[name],)), name)


SALES, CLICKS, CARTS, DELIVERIES = (fact(n) for n in WH.FACTS)
FACT_SQL = {
    "fact_sales": "(SELECT *, CAST(event_timestamp AS DATE) AS event_date FROM all_ev WHERE event_type = 'order' AND order_id IS NOT NULL)",
    "fact_clicks": "(SELECT *, CAST(event_timestamp AS DATE) AS event_date FROM all_ev WHERE event_type = 'click')",
    "fact_carts": "(SELECT *, CAST(event_timestamp AS DATE) AS event_date FROM all_ev WHERE event_type = 'cart')",
    "fact_deliveries": "(SELECT *, CAST(event_timestamp AS DATE) AS event_date FROM all_ev WHERE event_type = 'delivery')",
}
FS, FC, FK, FD = FACT_SQL.values()

# ---- fact rows -----------------------------------------------------------------
for n, (table, columns) in enumerate(
    {
        "fact_sales": "event_id, order_id, customer_id, product_id, quantity, "
        f"{amount('unit_cents')} AS unit_price, {amount('total_cents')} AS total_amount, status, "
        "event_timestamp, ingestion_timestamp, session_id, event_date",
        "fact_clicks": "event_id, customer_id, product_id, session_id, page, action, event_timestamp, "
        "ingestion_timestamp, event_date",
        "fact_carts": "event_id, cart_id, customer_id, product_id, session_id, quantity, action, "
        "event_timestamp, ingestion_timestamp, event_date",
        "fact_deliveries": "event_id, order_id, delivery_id, customer_id, status, carrier, "
        "estimated_delivery, actual_delivery, event_timestamp, ingestion_timestamp, event_date",
    }.items(),
    start=1,
):

    @query(f"dml{n}_{table}_rows", with_ctes(f"SELECT {columns} FROM {FACT_SQL[table]}", "all_ev"))
    def _(spark, root, table=table):
        return fact(table)(spark, root)


# ---- views -----------------------------------------------------------------------
SOLD = "count(DISTINCT order_id) AS total_orders"
ITEMS = f"{big('sum(quantity)')} AS total_items"


@query("vw1_sales_daily", with_ctes(
    f"SELECT event_date, count(*) AS total_sales, {SOLD}, count(DISTINCT customer_id) AS unique_customers, "
    f"{ITEMS}, {total()} AS gross_revenue, {mean()} AS average_order_value FROM {FS} {DONE} GROUP BY ALL", "all_ev"))
def _(spark, root):
    return views.sales_daily(SALES(spark, root))


NAMED = f"{FS} s LEFT JOIN dprod p ON s.product_id = p.product_id LEFT JOIN dcat c ON p.category_id = c.category_id"


@query("vw2_sales_by_product", with_ctes(
    "SELECT s.event_date, s.product_id, p.name AS product_name, p.category_id, c.name AS category_name, "
    f"{big('sum(s.quantity)')} AS total_quantity, {total('s.total_cents')} AS total_revenue, "
    f"count(DISTINCT s.order_id) AS total_orders FROM {NAMED} WHERE s.status IN ('completed', 'delivered') "
    "GROUP BY ALL", "all_ev", "dprod", "dcat"))
def _(spark, root):
    return views.sales_by_product(
        SALES(spark, root), R.dim_product(spark, root), R.dim_category(spark, root)
    )


@query("vw3_customer_sales", with_ctes(
    f"SELECT s.customer_id, c.name AS customer_name, c.segment, count(DISTINCT s.order_id) AS total_orders, "
    f"{big('sum(s.quantity)')} AS total_items, {total('s.total_cents')} AS total_spent, "
    f"{mean('s.total_cents')} AS average_order_value, min(s.event_date) AS first_purchase_date, "
    f"max(s.event_date) AS last_purchase_date FROM {FS} s LEFT JOIN dcust c ON s.customer_id = c.customer_id "
    "WHERE s.status IN ('completed', 'delivered') GROUP BY ALL", "all_ev", "dcust"))
def _(spark, root):
    return views.customer_sales(SALES(spark, root), R.dim_customer(spark, root))


@query("vw4_customer_behavior", with_ctes(
    "SELECT customer_id, count(*) AS total_clicks, count(DISTINCT product_id) AS unique_products_clicked, "
    f"count(DISTINCT session_id) AS total_sessions FROM {FC} GROUP BY ALL", "all_ev"))
def _(spark, root):
    return views.customer_behavior(CLICKS(spark, root))


@query("vw5_cart_behavior", with_ctes(
    f"SELECT customer_id, count(DISTINCT cart_id) AS total_carts, {big('sum(quantity)')} AS total_items_added, "
    f"count(*) AS total_cart_events FROM {FK} GROUP BY ALL", "all_ev"))
def _(spark, root):
    return views.cart_behavior(CARTS(spark, root))


@query("vw6_delivery_performance", with_ctes(
    "SELECT event_date, carrier, count(*) AS total_deliveries, "
    "count(*) FILTER (actual_delivery <= estimated_delivery) AS deliveries_on_time, "
    f"count(*) FILTER (actual_delivery > estimated_delivery) AS deliveries_delayed FROM {FD} GROUP BY ALL", "all_ev"))
def _(spark, root):
    return views.delivery_performance(DELIVERIES(spark, root))


@query("vw7_sales_delivery", with_ctes(
    "SELECT s.order_id, s.customer_id, s.product_id, s.event_date AS sale_date, "
    f"{amount('s.total_cents')} AS total_amount, d.delivery_id, d.status AS delivery_status, d.carrier, "
    "d.estimated_delivery, d.actual_delivery FROM (SELECT order_id, customer_id, product_id, "
    "CAST(event_timestamp AS DATE) AS event_date, total_cents FROM order_ev WHERE order_id IS NOT NULL UNION ALL "
    "SELECT order_id, customer_id, product_id, CAST(event_timestamp AS DATE), total_cents FROM activity_ev "
    "WHERE event_type = 'order' AND order_id IS NOT NULL) s LEFT JOIN (SELECT order_id, delivery_id, status, carrier, "
    "estimated_delivery, actual_delivery FROM delivery_ev) d ON s.order_id = d.order_id",
    "order_ev", "delivery_ev", "activity_ev"))
def _(spark, root):
    return views.sales_delivery(SALES(spark, root), DELIVERIES(spark, root))


# ---- reports ---------------------------------------------------------------------
@query("rq1_overview", with_ctes(
    f"SELECT count(*) AS total_sales, {SOLD}, count(DISTINCT customer_id) AS unique_customers, {ITEMS}, "
    f"{total()} AS gross_revenue, {mean_2()} AS average_order_value FROM {FS} {DONE}", "all_ev"))
def _(spark, root):
    return reports.overview(SALES(spark, root))


@query("rq2_daily_sales", with_ctes(
    f"SELECT event_date, count(*) AS total_sales, {SOLD}, {ITEMS}, {total()} AS revenue FROM {FS} {DONE} GROUP BY ALL",
    "all_ev"))
def _(spark, root):
    return reports.daily_sales(SALES(spark, root), ordered=False)


PER_PRODUCT = (
    f"SELECT s.product_id, p.name AS product_name, p.category_id, c.name AS category_name, "
    f"{big('sum(s.quantity)')} AS total_quantity, count(DISTINCT s.order_id) AS total_orders, "
    f"{total('s.total_cents')} AS total_revenue FROM {NAMED} WHERE s.status IN ('completed', 'delivered') GROUP BY ALL"
)


@query("rq3_top_products_by_revenue", with_ctes(
    f"{PER_PRODUCT} ORDER BY total_revenue DESC, product_id LIMIT 20", "all_ev", "dprod", "dcat"))
def _(spark, root):
    return reports.top_products_by_revenue(
        SALES(spark, root), R.dim_product(spark, root), R.dim_category(spark, root)
    )


@query("rq4_revenue_by_category", with_ctes(
    f"SELECT c.category_id, c.name AS category_name, {big('sum(s.quantity)')} AS total_items, "
    f"count(DISTINCT s.order_id) AS total_orders, {total('s.total_cents')} AS total_revenue FROM {NAMED} "
    "WHERE s.status IN ('completed', 'delivered') GROUP BY ALL", "all_ev", "dprod", "dcat"))
def _(spark, root):
    return reports.revenue_by_category(
        SALES(spark, root), R.dim_product(spark, root), R.dim_category(spark, root), ordered=False
    )


@query("rq5_top_customers_by_spend", with_ctes(
    f"SELECT s.customer_id, c.name AS customer_name, c.segment, count(DISTINCT s.order_id) AS total_orders, "
    f"{big('sum(s.quantity)')} AS total_items, {total('s.total_cents')} AS total_spent, "
    f"{mean_2('s.total_cents')} AS average_order_value FROM {FS} s LEFT JOIN dcust c ON s.customer_id = c.customer_id "
    "WHERE s.status IN ('completed', 'delivered') GROUP BY ALL ORDER BY total_spent DESC, s.customer_id LIMIT 20",
    "all_ev", "dcust"))
def _(spark, root):
    return reports.top_customers_by_spend(SALES(spark, root), R.dim_customer(spark, root))


@query("rq6_average_ticket", with_ctes(
    f"SELECT event_date, {mean_2()} AS average_order_value, {SOLD} FROM {FS} {DONE} GROUP BY ALL", "all_ev"))
def _(spark, root):
    return reports.average_ticket_by_day(SALES(spark, root), ordered=False)


@query("rq7_top_products_by_quantity", with_ctes(
    f"SELECT s.product_id, p.name AS product_name, {big('sum(s.quantity)')} AS total_quantity, "
    f"{total('s.total_cents')} AS total_revenue FROM {FS} s LEFT JOIN dprod p ON s.product_id = p.product_id "
    "WHERE s.status IN ('completed', 'delivered') GROUP BY ALL ORDER BY total_quantity DESC, s.product_id LIMIT 20",
    "all_ev", "dprod"))
def _(spark, root):
    return reports.top_products_by_quantity(SALES(spark, root), R.dim_product(spark, root))


@query("rq8_events_by_type", with_ctes(
    "SELECT event_type, count(*) AS total_events FROM all_ev GROUP BY ALL", "all_ev"))
def _(spark, root):
    return reports.events_by_type(R.all_events(spark, root), ordered=False)


@query("rq9_events_by_hour", with_ctes(
    f"SELECT {DAY}, hour(event_timestamp) AS event_hour, count(*) AS total_events FROM rough_ev "
    "WHERE event_timestamp IS NOT NULL GROUP BY ALL", "rough_ev"))
def _(spark, root):
    from ..operators.refine import normalize_columns
    from .scans import rough_events

    return reports.events_by_date_and_hour(normalize_columns(rough_events(spark, root)), ordered=False)


@query("rq10_required_field_gaps", with_ctes(
    "SELECT f AS field, f = 'ingestion_timestamp' AS column_absent, "
    "CASE f WHEN 'event_timestamp' THEN count(*) - count(event_timestamp) WHEN 'customer_id' THEN "
    "count(*) - count(customer_id) WHEN 'ingestion_timestamp' THEN count(*) ELSE 0 END AS rows_without_value "
    "FROM rough_ev, (SELECT unnest(['event_id', 'event_type', 'event_timestamp', 'ingestion_timestamp', "
    "'customer_id']) AS f) GROUP BY f", "rough_ev"))
def _(spark, root):
    from ..operators.refine import cast_timestamp_columns, normalize_columns
    from .scans import rough_events

    df = cast_timestamp_columns(normalize_columns(rough_events(spark, root)))
    return reports.required_field_gaps(df.drop("ingestion_timestamp"))


@query("rq11_fact_row_counts", with_ctes(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS total_records FROM {s}" for t, s in FACT_SQL.items()), "all_ev"))
def _(spark, root):
    return reports.fact_row_counts(facts(spark, root))


@query("rq12_count_by_type", with_ctes("SELECT event_type, count(*) AS total FROM all_ev GROUP BY ALL", "all_ev"))
def _(spark, root):
    return reports.count_by_event_type(R.all_events(spark, root))


# ---- dimensions -------------------------------------------------------------------
@query("ddl2_dim_date", with_ctes(
    "SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_sk, CAST(d AS DATE) AS calendar_date, year(d) AS year, "
    "quarter(d) AS quarter, month(d) AS month, strftime(d, '%B') AS month_name, weekofyear(d) AS week_of_year, "
    "day(d) AS day_of_month, dayofweek(d) + 1 AS day_of_week, strftime(d, '%A') AS day_name, "
    "dayofweek(d) IN (0, 6) AS is_weekend, day(d) = 1 AS is_month_start, "
    "CAST(d AS DATE) = last_day(d) AS is_month_end FROM (SELECT unnest(generate_series("
    "(SELECT date_trunc('day', min(event_timestamp)) FROM order_ev), "
    "(SELECT date_trunc('day', max(event_timestamp)) FROM order_ev), INTERVAL 1 DAY)) AS d)", "order_ev"))
def _(spark, root):
    return WH.dim_date(WH.date_span(R.order_events(spark, root)))


@query("ddl2_dim_product", with_ctes(
    f"SELECT product_sk, product_id, name, category_id, brand, {amount('price_cents')} AS price, "
    f"{big('stock_quantity')} AS stock_quantity, '' AS metadata FROM dprod", "dprod"))
def _(spark, root):
    return R.dim_product(spark, root)


@query("ddl2_dim_customer", with_ctes(
    "SELECT customer_sk, customer_id, name, replace(lower(name), '#', '.') || '@example.com' AS email, "
    "TIMESTAMP '1995-01-01' AS registration_date, segment, '' AS metadata FROM dcust", "dcust"))
def _(spark, root):
    return R.dim_customer(spark, root)


# ---- catalog: each query builds its own tables from the data and reads them back ----
def warehouse(spark, root, events=None):
    """Databases, tables, dimensions and facts of the activity events, freshly named."""
    path = scratch(spark, "warehouse")
    tag = path.rsplit("-", 1)[1]
    names = WH.Databases(f"core_{tag}", f"staging_{tag}", f"analytics_{tag}")
    WH.create_databases(spark, names, path)
    WH.create_dimensions(spark, names)
    WH.create_facts(spark, names)
    for table, df in (
        ("dim_customer", R.dim_customer(spark, root)),
        ("dim_product", R.dim_product(spark, root)),
        ("dim_category", R.dim_category(spark, root)),
    ):
        WH.load_dimension(df, table, names)
    source = curate.curate(R.activity_events(spark, root)) if events is None else events
    WH.backfill_all(source, names)
    return names, path


ACT = {k: v.replace("all_ev", "activity_ev") for k, v in FACT_SQL.items()}


@query("ddl3_warehouse_counts", with_ctes(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS total_records FROM {s}" for t, s in ACT.items())
    + " UNION ALL SELECT 'dim_customer', count(*) FROM dcust UNION ALL SELECT 'dim_product', count(*) FROM dprod "
    "UNION ALL SELECT 'dim_category', count(*) FROM dcat UNION ALL SELECT 'dim_date', "
    "CAST(0 AS BIGINT)", "activity_ev", "dcust", "dprod", "dcat"))
def _(spark, root):
    names, _ = warehouse(spark, root)
    WH.refresh_statistics(spark, names)
    tables = {t: spark.table(f"{names.core}.{t}") for t in (*WH.FACTS, *WH.DIMENSIONS)}
    return reports.fact_row_counts(tables)


def numbers_of(table, column, source, ranged=True):
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) - count({column}) AS num_nulls, CAST(min({column}) AS VARCHAR) "
        f"AS min, CAST(max({column}) AS VARCHAR) AS max, {str(ranged).lower()} AS has_histogram, true AS distinct_close FROM {source}")


@query("tm1_column_statistics", with_ctes(
    "SELECT table_name, column_name, CAST(num_nulls AS BIGINT) AS num_nulls, min, max, has_histogram, distinct_close FROM ("
    + " UNION ALL ".join([
        numbers_of("fact_sales", "quantity", ACT["fact_sales"]),
        numbers_of("fact_carts", "quantity", ACT["fact_carts"]),
        numbers_of("dim_customer", "customer_sk", "dcust", False),
        numbers_of("dim_product", "product_sk", "dprod", False),
        numbers_of("dim_product", "stock_quantity", "dprod"),
    ]) + ")", "activity_ev", "dcust", "dprod"))
def _(spark, root):
    """Statistics in the catalog next to the tables they were gathered from; distinct values are estimates."""
    names, _ = warehouse(spark, root)
    WH.refresh_statistics(spark, names, columns=True)
    out = []
    for table, columns in {
        "fact_sales": ["quantity"], "fact_carts": ["quantity"], "dim_customer": ["customer_sk"],
        "dim_product": ["product_sk", "stock_quantity"]}.items():
        known = WH.column_statistics(spark, table, columns, names.core)
        counts = spark.table(f"{names.core}.{table}").agg(
            *[F.count_distinct(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "_exact")
        out.append(known.join(counts, "column_name"))
    told, exact = F.col("distinct_count").cast("double"), F.col("_exact")
    return reduce(DataFrame.unionByName, out).select(
        "table_name", "column_name", F.col("num_nulls").cast("bigint").alias("num_nulls"), "min", "max", "has_histogram",
        (F.abs(told - exact) <= 0.2 * exact).alias("distinct_close"))


@query("ddl4_staging_repair", with_ctes(
    "SELECT CAST(event_timestamp AS DATE) AS event_date, count(*) AS n FROM activity_ev GROUP BY ALL", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "staging")
    tag = path.rsplit("-", 1)[1]
    names = WH.Databases(f"core_{tag}", f"staging_{tag}", f"analytics_{tag}")
    WH.create_databases(spark, names, path)
    WH.create_staging(spark, names, path)
    df = R.activity_events(spark, root).withColumns({
        "event_date": F.to_date("event_timestamp"),
        "unit_price": F.col("unit_price").cast("decimal(18,2)"),
        "total_amount": F.col("total_amount").cast("decimal(18,2)")})
    df.write.partitionBy("event_date").parquet(f"{path}/raw/events", mode="append")
    WH.repair_table(spark, "external_raw_events", names.staging)
    return spark.table(f"{names.staging}.external_raw_events").groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n"))


def fill(df, table):
    """The frame as rows of a table: its columns by name, null where the frame has none."""
    names = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields])


PER_DAY = "SELECT '{0}' AS table_name, CAST(event_timestamp AS DATE) AS event_date, count({1}) AS n FROM activity_ev {2} GROUP BY ALL"


@query("dml5_daily_partitions", with_ctes(" UNION ALL ".join([
    PER_DAY.format("external_raw_events", "*", ""),
    PER_DAY.format("external_clean_events", "*", ""),
    PER_DAY.format("external_curated_events", "*", ""),
    PER_DAY.format("external_streaming_metrics", "DISTINCT date_trunc('hour', event_timestamp)", ""),
    PER_DAY.format("external_streaming_alerts", "*", "WHERE event_type = 'order' AND total_cents >= 5000"),
]), "activity_ev"))
def _(spark, root):
    """Files of all five staging tables arrive in their folders; the daily load makes them visible."""
    names, path = warehouse(spark, root)
    WH.create_staging(spark, names, path)
    events = R.activity_events(spark, root)
    frames = {
        "external_raw_events": events,
        "external_clean_events": refine.clean(events),
        "external_curated_events": curate.curate(events),
        "external_streaming_metrics": W.process(events, 3600, 3600, ordered=False)
        .withColumns({"event_date": F.to_date("window_start"), "metric_value": F.col("total_amount")}),
        "external_streaming_alerts": A.detect(events, [A.large_order_value("50.00")]),
    }
    for name, df in frames.items():
        if "event_date" not in df.columns:
            df = df.withColumn("event_date", F.to_date("event_timestamp"))
        rows = fill(df, spark.table(f"{names.staging}.{name}"))
        rows.write.mode("append").partitionBy("event_date").parquet(f"{path}/{WH.STAGING_FOLDERS[name]}")
    WH.load_daily_partitions(spark, names)
    counts = [
        spark.table(f"{names.staging}.{t}").groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(t).alias("table_name"), "event_date", "n")
        for t in WH.STAGING
    ]
    return reduce(DataFrame.unionByName, counts)


@query("hc2_dropped_database", with_ctes(
    f"SELECT event_date, count(*) AS n, true AS dropped FROM {ACT['fact_clicks']} GROUP BY ALL", "activity_ev"))
def _(spark, root):
    """A database is made, a table in it finds its partitions, and the database goes with the table."""
    path = scratch(spark, "database")
    database = "db_" + path.rsplit("-", 1)[1]
    WH.create_database(spark, database, f"{path}/db")
    CLICKS(spark, root).write.partitionBy("event_date").parquet(f"{path}/clicks")
    columns = f"{WH.FACTS['fact_clicks']}, event_date DATE"
    WH.create_external_table(spark, "clicks", columns, f"{path}/clicks", ["event_date"], database)
    WH.recover_partitions(spark, "clicks", database)
    found = spark.table(f"{database}.clicks").groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    found.write.parquet(f"{path}/found")
    WH.drop_database(spark, database, cascade=True)
    gone = not spark.catalog.databaseExists(database)
    return spark.read.schema(found.schema).parquet(f"{path}/found").withColumn("dropped", F.lit(gone))


@query("ddl5_catalog_views", with_ctes(
    f"SELECT event_date, count(*) AS total_sales, {SOLD}, count(DISTINCT customer_id) AS unique_customers, {ITEMS}, "
    f"{total()} AS gross_revenue, {mean()} AS average_order_value FROM {ACT['fact_sales']} "
    "WHERE status = 'confirmed' GROUP BY ALL", "activity_ev"))
def _(spark, root):
    names, _ = warehouse(spark, root)
    views.create_views(spark, names, ["confirmed"])
    return spark.table(f"{names.analytics}.vw_sales_daily")


PAID = f"{ACT['fact_sales']} WHERE status = 'confirmed'"
VIEW_ROWS = {
    "vw_sales_daily": f"SELECT DISTINCT event_date FROM {PAID}",
    "vw_sales_by_product": f"SELECT DISTINCT event_date, product_id FROM {PAID}",
    "vw_customer_sales": f"SELECT DISTINCT customer_id FROM {PAID}",
    "vw_customer_behavior": f"SELECT DISTINCT customer_id FROM {ACT['fact_clicks']}",
    "vw_cart_behavior": f"SELECT DISTINCT customer_id FROM {ACT['fact_carts']}",
    "vw_delivery_performance": f"SELECT DISTINCT event_date, carrier FROM {ACT['fact_deliveries']}",
    "vw_sales_delivery": f"SELECT 1 FROM {ACT['fact_sales']} s LEFT JOIN {ACT['fact_deliveries']} d USING (order_id)",
}


@query("dml7_probed_views", with_ctes(
    " UNION ALL ".join(f"SELECT '{v}' AS view, count(*) AS rows FROM ({q}) q" for v, q in VIEW_ROWS.items()),
    "activity_ev"))
def _(spark, root):
    names, _ = warehouse(spark, root)
    views.create_views(spark, names, ["confirmed"])
    return WH.probe_views(spark, names, views.VIEW_NAMES)


def catalog_view(name):
    def build(spark, root):
        names, _ = warehouse(spark, root)
        views.create_views(spark, names, ["confirmed"])
        return spark.table(f"{names.analytics}.{name}")

    return build


query("ddl5_view_customer_behavior", with_ctes(
    "SELECT customer_id, count(*) AS total_clicks, count(DISTINCT product_id) AS unique_products_clicked, "
    f"count(DISTINCT session_id) AS total_sessions FROM {ACT['fact_clicks']} GROUP BY customer_id",
    "activity_ev"))(catalog_view("vw_customer_behavior"))
query("ddl5_view_cart_behavior", with_ctes(
    f"SELECT customer_id, count(DISTINCT cart_id) AS total_carts, {big('sum(quantity)')} AS total_items_added, "
    f"count(*) AS total_cart_events FROM {ACT['fact_carts']} GROUP BY customer_id",
    "activity_ev"))(catalog_view("vw_cart_behavior"))
query("ddl5_view_customer_sales", with_ctes(
    f"SELECT s.customer_id, any_value(c.name) AS customer_name, any_value(c.segment) AS segment, {SOLD}, {ITEMS}, "
    f"{total()} AS total_spent, {mean()} AS average_order_value, min(event_date) AS first_purchase_date, "
    f"max(event_date) AS last_purchase_date FROM {ACT['fact_sales']} s LEFT JOIN dcust c ON s.customer_id = c.customer_id "
    "WHERE status = 'confirmed' GROUP BY s.customer_id",
    "activity_ev", "dcust"))(catalog_view("vw_customer_sales"))


@query("pm3_show_partitions", with_ctes(
    f"SELECT DISTINCT 'event_date=' || CAST(event_date AS VARCHAR) AS partition FROM {ACT['fact_clicks']}", "activity_ev"))
def _(spark, root):
    names, _ = warehouse(spark, root)
    return WH.show_partitions(spark, "fact_clicks", names.core)


@query("pm7_drop_partition", with_ctes(
    f"SELECT event_date, count(*) AS n, true AS existed FROM {ACT['fact_carts']} WHERE event_date <> DATE '2024-01-05' "
    "GROUP BY ALL", "activity_ev"))
def _(spark, root):
    names, _ = warehouse(spark, root)
    day = {"event_date": "2024-01-05"}
    existed = WH.drop_partition_if_exists(spark, "fact_carts", day, names.core)
    again = WH.drop_partition_if_exists(spark, "fact_carts", day, names.core)
    return spark.table(f"{names.core}.fact_carts").groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n"), F.lit(existed and not again).alias("existed"))


@query("pm1_add_partition", with_ctes(
    f"SELECT event_date, count(*) AS n FROM {ACT['fact_clicks']} GROUP BY ALL", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "parts")
    table = "clicks_" + path.rsplit("-", 1)[1]
    rows = CLICKS(spark, root)
    rows.write.partitionBy("event_date").parquet(f"{path}/all")
    WH.create_external_table(spark, table, f"{WH.FACTS['fact_clicks']}, event_date DATE", f"{path}/table", ["event_date"])
    days = spark.read.parquet(f"{path}/all").select(F.col("event_date").cast("string")).distinct()
    for (day,) in days.collect():  # one row per day of the calendar
        WH.add_partition(spark, table, {"event_date": day}, location=f"{path}/all/event_date={day}")
    return spark.table(table).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


DESCRIBED = {
    "event_id": "string", "order_id": "string", "customer_id": "string", "product_id": "string", "quantity": "int",
    "unit_price": "decimal(18,2)", "total_amount": "decimal(18,2)", "status": "string", "event_timestamp": "timestamp",
    "ingestion_timestamp": "timestamp", "session_id": "string", "event_date": "date"}
STORED_AS = {"unit_price": "unit_cents", "total_amount": "total_cents"}


@query("tm5_describe_table", with_ctes(" UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS col_name, '{t}' AS data_type, count({STORED_AS.get(c, c)}) AS filled "
    f"FROM {ACT['fact_sales']}" for i, (c, t) in enumerate(DESCRIBED.items())), "activity_ev"))
def _(spark, root):
    """The columns of the loaded table, each with the number of rows that have a value in it."""
    names, _ = warehouse(spark, root)
    table = spark.table(f"{names.core}.fact_sales")
    filled = table.agg(*[F.count(c).alias(c) for c in table.columns])
    filled = filled.unpivot([], table.columns, "col_name", "filled")
    return WH.describe_table(spark, "fact_sales", names.core).join(filled, "col_name")


@query("tm7_truncate_rename", with_ctes(
    "SELECT 'renamed' AS table_name, count(*) AS total_records FROM activity_ev UNION ALL SELECT 'truncated', "
    "CAST(0 AS BIGINT)", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "tables")
    database = "tm_" + path.rsplit("-", 1)[1]
    df = R.activity_events(spark, root)
    catalog.ensure_database(spark, database, f"{path}/db")
    for table in ("first_copy", "second_copy", "third_copy"):
        catalog.load(df, table, "overwrite", database=database, path=f"{path}/{table}")
    WH.rename_table(spark, "first_copy", "renamed", database)
    catalog.load(df, "truncated", "overwrite", database=database)
    WH.truncate_table(spark, "truncated", database)
    catalog.drop_table(spark, "second_copy", database)
    catalog.drop_table(spark, "third_copy", database, purge=True)
    listed = [r.table_name for r in WH.show_tables(spark, database).collect()]
    return reports.fact_row_counts({t: spark.table(f"{database}.{t}") for t in sorted(listed)})


@query("snk11_insert_by_name", with_ctes(
    "SELECT event_type, count(*) * 2 AS n FROM activity_ev GROUP BY ALL", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "insert")
    table = "insert_" + path.rsplit("-", 1)[1]
    df = R.activity_events(spark, root).select("event_id", "event_type", "quantity")
    catalog.load(df, table, "overwrite", path=path)
    catalog.insert_sql(df.select("event_type", "quantity", "event_id"), table)
    return spark.table(table).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("snk9_load_partitioned", with_ctes(
    f"SELECT {DAY}, count(*) AS n FROM activity_ev GROUP BY ALL", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "load")
    table = "load_" + path.rsplit("-", 1)[1]
    df = R.activity_events(spark, root).withColumn("event_date", F.to_date("event_timestamp"))
    catalog.load_partitioned(df, table, path=path)
    catalog.load_overwrite(df, table, ["event_date"], path=path)
    return spark.table(table).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


@query("dml1_backfill_keeps_other_dates", with_ctes(
    f"SELECT event_date, CASE WHEN event_date >= DATE '2024-01-20' THEN count(*) FILTER (total_cents >= 1000) "
    f"ELSE count(*) END AS n FROM {ACT['fact_sales']} GROUP BY event_date", "activity_ev"))
def _(spark, root):
    names, _ = warehouse(spark, root)
    late = curate.curate(R.activity_events(spark, root)).filter(
        (F.col("event_date") >= "2024-01-20") & (F.col("total_amount") >= 10))
    WH.backfill(late, "fact_sales", names)
    return spark.table(f"{names.core}.fact_sales").groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


# ---- partition columns ---------------------------------------------------------------
@query("pt1_partition_columns", with_ctes(
    "SELECT event_id, year(event_timestamp) AS year, month(event_timestamp) AS month, day(event_timestamp) AS day, "
    "hour(event_timestamp) AS hour, strftime(event_timestamp, '/base/year=%Y/month=%m/day=%d') AS path, "
    "'year=' || year(event_timestamp) || ', month=' || month(event_timestamp) || ', day=' || day(event_timestamp) "
    "|| ', hour=' || hour(event_timestamp) AS spec FROM all_ev", "all_ev"))
def _(spark, root):
    from ..functions.timestamps import partition_path, partition_spec, partition_values

    df = R.all_events(spark, root)
    return df.select(
        "event_id", *[c.alias(n) for n, c in partition_values("event_timestamp").items()],
        partition_path("/base/", "event_timestamp").alias("path"),
        partition_spec("event_timestamp", include_hour=True).alias("spec"),
    )


@query("pt2_date_range", with_ctes(
    "SELECT CAST(unnest(generate_series((SELECT date_trunc('day', min(event_timestamp)) FROM activity_ev), "
    "(SELECT date_trunc('day', max(event_timestamp)) FROM activity_ev), INTERVAL 1 DAY)) AS DATE) AS day", "activity_ev"))
def _(spark, root):
    span = WH.date_span(R.activity_events(spark, root))
    return span.select(WH.create_range(F.col("start"), F.col("end")).alias("day"))


@query("pt5_type_partitions", with_ctes("SELECT event_type, count(*) AS n FROM activity_ev GROUP BY ALL", "activity_ev"))
def _(spark, root):
    from ..sinks import files
    from ..sources import readers

    path = scratch(spark, "by_type")
    files.write_parquet(R.activity_events(spark, root), path, partition_by=["event_type"])
    return readers.read_parquet(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
