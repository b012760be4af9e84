"""Raw to clean to curated, record steps, and the multi-step runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate, features, refine
from ..plans import batch
from ..session import FREE_SHUFFLES, scratch, settings
from ..sinks import catalog, files
from ..sources import relational as R
from .base import COLUMNS, amount, big, flag, mean_2, query, step, total, with_ctes
from .marts import DAY
from .scans import rough_events
from .transforms import shouted

EVENT_OUT = COLUMNS.replace("unit_cents", f"{amount('unit_cents')} AS unit_price").replace(
    "total_cents", f"{amount('total_cents')} AS total_amount"
)
SHORT = "event_id, event_type, event_timestamp, ingestion_timestamp, customer_id"


@query("prj1_normalize_events", with_ctes(
    f"SELECT {SHORT}, CAST(event_timestamp AS DATE) AS event_date FROM rough_ev", "rough_ev"))
def _(spark, root):
    df = refine.normalize_columns(rough_events(spark, root))
    return refine.normalize_events(df).select(*[c.strip() for c in SHORT.split(",")], "event_date")


@query("prj2_process_events", with_ctes(
    "SELECT count(*) AS total_events, count(*) FILTER (event_type = 'click') AS click_events, "
    "count(*) FILTER (event_type = 'cart') AS cart_events, count(*) FILTER (event_type = 'order') AS "
    "order_events, count(*) FILTER (event_type = 'delivery') AS delivery_events FROM rough_ev", "rough_ev"))
def _(spark, root):
    return batch.branch_counts(refine.normalize_columns(rough_events(spark, root)))


@query("prj2_typed_branches", with_ctes(
    "SELECT CASE event_type WHEN 'order' THEN 'sales' ELSE event_type END AS branch, count(*) AS n, "
    "count(DISTINCT customer_id) AS customers FROM rough_ev GROUP BY ALL", "rough_ev"))
def _(spark, root):
    frames = batch.process_events(refine.normalize_columns(rough_events(spark, root)))
    parts = [
        frames[name].select(F.lit(name).alias("branch"), "customer_id")
        for name in ("click", "cart", "sales", "delivery")
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return merged.groupBy("branch").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("customers")
    )


@query("prj3_column_names", with_ctes("SELECT event_id, quantity, page FROM all_ev", "all_ev"))
def _(spark, root):
    return refine.normalize_columns(rough_events(spark, root)).select("event_id", "quantity", "page")


@query("prj4_cast_times", with_ctes(
    "SELECT event_id, event_timestamp, ingestion_timestamp FROM rough_ev", "rough_ev"))
def _(spark, root):
    df = refine.normalize_columns(rough_events(spark, root))
    return refine.cast_timestamp_columns(df).select("event_id", "event_timestamp", "ingestion_timestamp")


@query("flt1_required_fields", with_ctes(
    "SELECT event_id, customer_id, event_timestamp FROM rough_ev "
    "WHERE event_timestamp IS NOT NULL AND customer_id IS NOT NULL", "rough_ev"))
def _(spark, root):
    df = refine.cast_timestamp_columns(refine.normalize_columns(rough_events(spark, root)))
    return refine.remove_invalid_events(df).select("event_id", "customer_id", "event_timestamp")


def _first_row(source: str) -> str:
    from .base import TIE_BREAK

    return (
        f"SELECT {EVENT_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY event_id "
        f"ORDER BY {TIE_BREAK}) AS rn FROM {source}) WHERE rn = 1"
    )


def event_out(df):
    return df.select(
        *[
            {"unit_cents": "unit_price", "total_cents": "total_amount"}.get(c.strip(), c.strip())
            for c in COLUMNS.split(",")
        ]
    )


@query("ded1_drop_duplicates", with_ctes(_first_row("all_ev"), "all_ev"))
def _(spark, root):
    return event_out(refine.drop_duplicates(R.all_events(spark, root)))


@query("ded1_whole_row_duplicates", with_ctes(
    "SELECT DISTINCT customer_id, product_id, quantity FROM order_ev", "order_ev"))
def _(spark, root):
    df = R.order_events(spark, root).select("customer_id", "product_id", "quantity")
    return refine.drop_duplicates(df)


CLEAN = with_ctes(
    f"SELECT {SHORT}, product_id, quantity, order_id, status FROM clean_ev", "clean_ev"
)
CLEAN_COLUMNS = [c.strip() for c in SHORT.split(",")] + ["product_id", "quantity", "order_id", "status"]


@query("pip1_clean", CLEAN)
def _(spark, root):
    return refine.clean(rough_events(spark, root)).select(*CLEAN_COLUMNS)


@query("pip2_raw_to_clean", CLEAN)
def _(spark, root):
    raw, clean = scratch(spark, "raw"), scratch(spark, "clean")
    df = refine.normalize_columns(rough_events(spark, root))
    df.write.parquet(raw)
    out = batch.raw_to_clean(spark, raw, clean, ["event_type"], fmt="parquet")
    return out.select(*CLEAN_COLUMNS)


# ---- curated -------------------------------------------------------------------
step("prj5_event_date", R.all_events, curate.add_event_date,
     {"event_date": "CAST(event_timestamp AS DATE)"}, "all_ev")
step("prj6_event_hour", R.all_events, curate.add_event_hour, {"event_hour": "hour(event_timestamp)"},
     "all_ev")
step("prj7_order_metrics", R.all_events, curate.add_order_metrics,
     {"total_amount": amount("total_cents")}, "all_ev")
step("prj7_order_total_filled", lambda s, r: R.order_events(s, r).drop("total_amount"),
     curate.add_order_metrics, {"total_amount": amount("(quantity * unit_cents)")}, "order_ev")
step("prj8_date_parts", R.all_events, curate.add_processing_metadata,
     {"event_year": "year(event_timestamp)", "event_month": "month(event_timestamp)",
      "event_day": "day(event_timestamp)"}, "all_ev")

DELAY_SECONDS = "CAST(epoch_us(ingestion_timestamp) - epoch_us(event_timestamp) AS DOUBLE) / 1000000"
CURATED = (
    f"{EVENT_OUT}, CAST(event_timestamp AS DATE) AS event_date, hour(event_timestamp) AS event_hour, "
    "year(event_timestamp) AS event_year, month(event_timestamp) AS event_month, "
    f"day(event_timestamp) AS event_day, {DELAY_SECONDS} AS event_delay_seconds, "
    "ingestion_timestamp > event_timestamp AS is_late_event"
)


@query("prj9_curated_columns", with_ctes(f"SELECT {EVENT_OUT} FROM activity_ev", "activity_ev"))
def _(spark, root):
    df = R.activity_events(spark, root).withColumn("not_curated", F.lit(1))
    return curate.select_curated_columns(df)


@query("pip3_curate", with_ctes(f"SELECT {CURATED} FROM all_ev", "all_ev"))
def _(spark, root):
    return curate.curate(R.all_events(spark, root))


@query("pip4_clean_to_curated", with_ctes(f"SELECT {CURATED} FROM all_ev", "all_ev"))
def _(spark, root):
    clean, curated = scratch(spark, "clean"), scratch(spark, "curated")
    files.write_clean(R.all_events(spark, root), clean)
    return batch.clean_to_curated(spark, clean, curated, ["event_type"]).select(
        *curate.curate(R.all_events(spark, root)).columns
    )


@query("pip10_curated_to_features", with_ctes(
    "SELECT year(event_timestamp) AS event_year, month(event_timestamp) AS event_month, count(*) AS n, "
    f"{big('sum(CASE WHEN total_cents >= 1000000 THEN 1 ELSE 0 END)')} AS high_value_orders "
    "FROM all_ev GROUP BY ALL", "all_ev"))
def _(spark, root):
    curated, out = scratch(spark, "curated"), scratch(spark, "features")
    with settings(spark, FREE_SHUFFLES):
        files.write_curated(curate.curate(R.all_events(spark, root)), curated)
    return batch.curated_to_features(spark, curated, out).groupBy("event_year", "event_month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("high_value_order").alias("high_value_orders")
    )


@query("snk26_daily_marts", with_ctes(
    "SELECT 'sales' AS mart, CAST(event_timestamp AS DATE) AS event_date, count(*) AS n FROM activity_ev "
    "WHERE event_type = 'order' GROUP BY ALL UNION ALL SELECT 'events', CAST(event_timestamp AS DATE), "
    "count(*) FROM activity_ev GROUP BY ALL UNION ALL SELECT 'clicks', CAST(event_timestamp AS DATE), count(*) "
    "FROM activity_ev WHERE event_type = 'click' GROUP BY ALL UNION ALL SELECT 'carts', "
    "CAST(event_timestamp AS DATE), count(*) FROM activity_ev WHERE event_type = 'cart' GROUP BY ALL UNION ALL "
    "SELECT 'deliveries', CAST(event_timestamp AS DATE), count(*) FROM activity_ev WHERE event_type = "
    "'delivery' GROUP BY ALL", "activity_ev"))
def _(spark, root):
    curated, out = scratch(spark, "curated"), scratch(spark, "marts")
    files.write_curated(curate.curate(R.activity_events(spark, root)), curated)
    marts = batch.daily_marts(spark, curated, out)
    counted = {"sales": "total_orders", "events": "total_events", "clicks": "total_clicks",
               "carts": "total_cart_events", "deliveries": "total_delivery_events"}
    parts = [
        marts[m].select(F.lit(m).alias("mart"), "event_date", F.col(c).alias("n"))
        for m, c in counted.items()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


@query("snk7_batch_run", with_ctes(
    f"SELECT {DAY}, count(*) AS total_orders, count(DISTINCT order_id) AS unique_orders, "
    f"count(DISTINCT customer_id) AS unique_customers, {big('sum(quantity)')} AS total_items, "
    f"{total()} AS total_sales, {mean_2()} AS average_order_value FROM activity_ev "
    "WHERE event_type = 'order' GROUP BY ALL", "activity_ev"))
def _(spark, root):
    raw, out = scratch(spark, "raw"), scratch(spark, "batch")
    database = "batch_" + out.rsplit("-", 1)[1]
    files.write_jsonl(R.activity_events(spark, root), raw)
    catalog.ensure_database(spark, database, f"{out}/db")
    batch.run_batch(spark, raw, out, database)
    return spark.table(f"{database}.daily_sales_summary")


# ---- record steps ----------------------------------------------------------------
step("rdd1_filter_by_type", R.all_events, lambda df: refine.filter_by_event_type(df, "delivery"),
     {"event_type": "event_type"}, "all_ev", "WHERE event_type = 'delivery'")


@query("rdd2_valid_records", with_ctes(
    "SELECT event_id, event_type FROM all_ev WHERE coalesce(quantity, 0) <> 7", "all_ev"))
def _(spark, root):
    df = R.all_events(spark, root).withColumn(
        "event_id", F.when(F.col("quantity") == 7, F.lit("")).otherwise(F.col("event_id"))
    )
    return refine.filter_valid_events(df).select("event_id", "event_type")


step("rdd4_normalized_records", shouted(R.all_events, "event_type"), refine.map_normalize,
     {"event_type": "event_type"}, "all_ev")


@query("rdd5_distinct_records", with_ctes(
    "SELECT event_id, count(*) AS copies FROM (SELECT DISTINCT event_id FROM all_ev) GROUP BY ALL", "all_ev"))
def _(spark, root):
    return refine.distinct_events(R.all_events(spark, root)).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("copies")
    )


@query("rdd7_records_by_customer", with_ctes(
    "SELECT customer_id, count(*) AS n FROM rough_ev WHERE customer_id IS NOT NULL GROUP BY ALL", "rough_ev"))
def _(spark, root):
    df = refine.normalize_columns(rough_events(spark, root))
    return refine.key_by_customer(df).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))


step("rdd8_map_values", R.order_events,
     lambda df: refine.map_values(df, "quantity", lambda q: q * 2 + 1), {"quantity": big("quantity * 2 + 1")},
     "order_ev")


@query("rdd13_record_count", with_ctes("SELECT count(*) AS n FROM all_ev", "all_ev"))
def _(spark, root):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return R.all_events(spark, root).repartition(parts).coalesce(max(1, parts // 2)).agg(F.count(F.lit(1)).alias("n"))


@query("rdd14_record_run", with_ctes(
    "SELECT DISTINCT event_id, event_type FROM all_ev WHERE event_type = 'order'", "all_ev"))
def _(spark, root):
    df = shouted(R.all_events, "event_type")(spark, root)
    return refine.valid_records(df, "order").select("event_id", "event_type")


@query("sql3_sql_list", with_ctes(
    f"SELECT status, count(*) AS n, {total()} AS revenue FROM order_ev GROUP BY ALL", "order_ev"))
def _(spark, root):
    batch.register_temp_view(R.order_events(spark, root), "order_events_view")
    return batch.run_sql_list(spark, [
        "SELECT count(1) AS n FROM order_events_view",
        "SELECT status, count(1) AS n, CAST(sum(total_amount) AS DOUBLE) AS revenue "
        "FROM order_events_view GROUP BY status",
    ])[1]
