"""Windows, watermarks, row mapping and filters on event frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timestamps
from ..functions.predicates import event_delay_seconds, is_late_event
from ..operators import refine
from ..operators import windows as W
from ..operators.typed import only_type
from ..sources import relational as R
from .base import amount, big, query, step, with_ctes
from .by_key import KIND, MONEY_0
from .scans import rough_events

FLOOR = "(epoch_us(event_timestamp) // 10000000 * 10)"
STARTS = "(SELECT unnest(range(6)) AS i) w"
START = f"make_timestamp(({FLOOR} - 10 * i) * 1000000)"
COVERED = f"FROM activity_ev, {STARTS}"

# ---- window arithmetic ---------------------------------------------------------
step("wn1_floor", R.activity_events,
     lambda df: df.withColumns({"floor_10": timestamps.floor_timestamp("event_timestamp", 10),
                                "floor_60": timestamps.floor_timestamp("event_timestamp", 60)}),
     {"floor_10": f"make_timestamp({FLOOR} * 1000000)",
      "floor_60": "date_trunc('minute', event_timestamp)"}, "activity_ev")
step("wn2_first_start", R.activity_events,
     lambda df: df.withColumns({"window_start": W.calculate_window_start("event_timestamp"),
                                "latest_start": W.window_start_floor("event_timestamp")}),
     {"window_start": f"make_timestamp(({FLOOR} - 50) * 1000000)",
      "latest_start": f"make_timestamp({FLOOR} * 1000000)"}, "activity_ev")
step("wn4_window_end", R.activity_events,
     lambda df: df.withColumn("window_end", W.calculate_window_end(W.calculate_window_start("event_timestamp"))),
     {"window_end": f"make_timestamp(({FLOOR} + 10) * 1000000)"}, "activity_ev")
step("wn5_membership", R.activity_events,
     lambda df: df.withColumns(
         {"in_first": W.is_event_in_window("event_timestamp", W.calculate_window_start("event_timestamp")),
          "in_next": W.contains("event_timestamp",
                                W.calculate_window_end(W.window_start_floor("event_timestamp"), 10),
                                W.calculate_window_end(W.window_start_floor("event_timestamp"), 70))}),
     {"in_first": "true", "in_next": "false"}, "activity_ev")


@query("wn3_window_starts", with_ctes(f"SELECT event_id, {START} AS window_start {COVERED}", "activity_ev"))
def _(spark, root):
    return W.assign_events(R.activity_events(spark, root)).select("event_id", "window_start")


@query("wn8_rows_per_window", with_ctes(
    f"SELECT {START} AS window_start, count(*) AS n {COVERED} GROUP BY ALL", "activity_ev"))
def _(spark, root):
    assigned = W.assign_events(R.activity_events(spark, root))
    return assigned.groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))


@query("wn9_rows_per_key_and_window", with_ctes(
    f"SELECT customer_id AS key, {START} AS window_start, count(*) AS n {COVERED} GROUP BY ALL", "activity_ev"))
def _(spark, root):
    assigned = W.assign_events_by_key(R.activity_events(spark, root))
    return assigned.groupBy("key", "window_start").agg(F.count(F.lit(1)).alias("n"))


WINDOW = (
    f"{KIND} AS event_type, count(*) AS event_count, count(DISTINCT customer_id) AS unique_customers, "
    f"{big('sum(coalesce(quantity, 0))')} AS total_quantity, {MONEY_0} AS total_amount"
)


TYPES = "string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types"


def window_sql(source: str, key: str | None = None, size: int = 60, slide: int = 10) -> str:
    floor = f"(epoch_us(event_timestamp) // {slide * 1000000} * {slide})"
    start = f"make_timestamp(({floor} - {slide} * i) * 1000000)"
    owner = key or "CAST(NULL AS VARCHAR)"
    inner = (
        f"SELECT {start} AS window_start, {start} + INTERVAL {size} SECOND AS window_end, {owner} AS key, "
        f"event_type, customer_id, quantity, total_cents FROM {source}, "
        f"(SELECT unnest(range({size // slide})) AS i)"
    )
    kind = WINDOW.replace("AS event_type", "AS kind")
    return with_ctes(
        f"SELECT * EXCLUDE (kind, types), kind AS event_type FROM (SELECT 'window_size_seconds={size};"
        f"window_slide_seconds={slide};window_type=sliding' AS metadata, {TYPES}, window_start, window_end, key, {kind} "
        f"FROM ({inner}) GROUP BY window_start, window_end, key)", source)


@query("wn11_sliding_overall", window_sql("activity_ev"))
def _(spark, root):
    return W.process(R.activity_events(spark, root), ordered=False)


@query("wn12_sliding_by_customer", window_sql("activity_ev", "customer_id"))
def _(spark, root):
    return W.process_by_key(R.activity_events(spark, root), ordered=False)


@query("wn10_tumbling_hour_mixed", window_sql("all_ev", None, 3600, 3600))
def _(spark, root):
    return W.process(R.all_events(spark, root), 3600, 3600, ordered=False)


@query("wn13_windows_with_rows", with_ctes(
    f"SELECT {START} AS window_start, {START} + INTERVAL 60 SECOND AS window_end, event_id {COVERED}",
    "activity_ev"))
def _(spark, root):
    return W.iter_windows(R.activity_events(spark, root)).select("window_start", "window_end", "event_id")


# ---- watermarks ------------------------------------------------------------------
def shuffled_arrivals(spark, root):
    """Activity events whose arrival lags by up to 40 minutes, so many arrive late."""
    df = R.activity_events(spark, root)
    lag = F.coalesce(F.length("customer_id") * 7 + F.substring("product_id", 3, 3).cast("int") % 17, F.lit(0))
    return df.withColumn(
        "ingestion_timestamp", F.date_trunc("minute", F.col("event_timestamp") + F.make_dt_interval(mins=lag))
    )


ARRIVED = (
    "(SELECT * REPLACE (date_trunc('minute', event_timestamp + to_minutes(CAST(length(customer_id) * 7 + "
    "CAST(substr(product_id, 3, 3) AS INT) % 17 AS INT))) AS ingestion_timestamp) FROM activity_ev)"
)
RUNNING = (
    "max(event_timestamp) OVER (ORDER BY ingestion_timestamp RANGE BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW) - INTERVAL 10 SECOND"
)


@query("wm1_watermark_by_arrival", with_ctes(
    f"SELECT DISTINCT ingestion_timestamp, {RUNNING} AS watermark FROM {ARRIVED}", "activity_ev"))
def _(spark, root):
    return W.watermark_by_arrival(shuffled_arrivals(spark, root))


@query("wm2_watermark_after_all", with_ctes(
    "SELECT max(event_timestamp) - INTERVAL 10 SECOND AS watermark FROM all_ev", "all_ev"))
def _(spark, root):
    return R.all_events(spark, root).agg(
        W.calculate_watermark(F.max("event_timestamp")).alias("watermark")
    )


@query("wm5_lateness_labels", with_ctes(
    f"SELECT event_id, w AS watermark, CASE WHEN event_timestamp < w - INTERVAL 10 SECOND THEN 'dropped' "
    "WHEN event_timestamp < w THEN 'allowed' ELSE 'on_time' END AS lateness, w >= event_timestamp AS passed, "
    "event_timestamp < w AS late, event_timestamp < w - INTERVAL 10 SECOND AS too_late, "
    "event_timestamp >= w - INTERVAL 10 SECOND AS tolerated "
    f"FROM (SELECT event_id, event_timestamp, {RUNNING} AS w FROM {ARRIVED})", "activity_ev"))
def _(spark, root):
    labelled = W.label_lateness(shuffled_arrivals(spark, root))
    return labelled.select(
        "event_id", "watermark", "lateness",
        W.is_after("watermark", "event_timestamp").alias("passed"),
        W.is_late("event_timestamp", "watermark").alias("late"),
        W.is_late_event("event_timestamp", "watermark").alias("too_late"),
        W.is_within_allowed_lateness("event_timestamp", "watermark").alias("tolerated"),
    )


MICROS = "(epoch_us(ingestion_timestamp) - epoch_us(event_timestamp))"
step("wm7_times", R.activity_events,
     lambda df: df.withColumns(
         {"event_ms": F.unix_millis("event_timestamp"), "ingestion_ms": F.unix_millis("ingestion_timestamp"),
          "is_late_candidate": is_late_event(),
          "is_ordered": F.col("event_timestamp") <= F.col("ingestion_timestamp"),
          "delay_seconds": F.greatest(F.lit(0.0), event_delay_seconds())}),
     {"event_ms": "epoch_us(event_timestamp) // 1000", "ingestion_ms": "epoch_us(ingestion_timestamp) // 1000",
      "is_late_candidate": "ingestion_timestamp > event_timestamp",
      "is_ordered": "event_timestamp <= ingestion_timestamp",
      "delay_seconds": f"greatest(0.0, CAST({MICROS} AS DOUBLE) / 1000000)"}, "activity_ev")


@query("wm10_time_metadata", with_ctes(
    f"SELECT event_id, 'delay_seconds=' || ({MICROS} // 1000000) || ';event_ms=' || (epoch_us(event_timestamp) // 1000) "
    "|| ';ingestion_ms=' || (epoch_us(ingestion_timestamp) // 1000) || ';kind=' || event_type || ';zone=UTC' AS metadata "
    "FROM all_ev", "all_ev"))
def _(spark, root):
    df = R.all_events(spark, root).withColumn(
        "metadata", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("zone"), F.lit("unknown"))
    )
    return W.with_time_metadata(df).select("event_id", "metadata")


# ---- row mapping -----------------------------------------------------------------
@query("mp1_normalized_rows", with_ctes(
    "SELECT event_id, event_type, status, customer_id FROM rough_ev WHERE customer_id IS NOT NULL", "rough_ev"))
def _(spark, root):
    df = refine.normalize_columns(rough_events(spark, root))
    return refine.normalize_stream_event(df).select("event_id", "event_type", "status", "customer_id")


@query("mp2_enriched_rows", with_ctes(
    "SELECT event_id, 'batch' AS origin, event_type AS kind, true AS stamped FROM all_ev", "all_ev"))
def _(spark, root):
    df = R.all_events(spark, root).withColumn(
        "metadata", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("origin"), F.lit("feed"))
    )
    out = refine.enrich_metadata(df, {"origin": "batch"})
    return out.select(
        "event_id", out["metadata"]["origin"].alias("origin"), out["metadata"]["kind"].alias("kind"),
        out["metadata"]["processed_at"].isNotNull().alias("stamped"),
    )


step("mp5_event_value", R.all_events,
     lambda df: df.withColumn("event_value", refine.event_value()),
     {"event_value": amount("coalesce(unit_cents * quantity, 0)")}, "all_ev")


# ---- filters ---------------------------------------------------------------------
@query("fo1_valid_rows", with_ctes(
    "SELECT event_id, event_type FROM rough_ev WHERE event_timestamp IS NOT NULL AND customer_id IS NOT NULL "
    "AND NOT coalesce(quantity > 25, false)", "rough_ev"))
def _(spark, root):
    """Types stay as sent here, so the shouted ones are not supported."""
    df = refine.cast_timestamp_columns(refine.normalize_columns(rough_events(spark, root)))
    return W.filter_valid_events(df).select("event_id", "event_type")


@query("fo2_types_in_set", with_ctes(
    "SELECT event_id, event_type FROM all_ev WHERE event_type IN ('click', 'order')", "all_ev"))
def _(spark, root):
    return W.filter_by_event_type(R.all_events(spark, root), {"click", "order"}).select("event_id", "event_type")


for n, kind in ((3, "click"), (4, "cart"), (5, "order"), (6, "delivery")):

    @query(f"fo{n}_{kind}_rows", with_ctes(
        f"SELECT event_id, customer_id FROM all_ev WHERE event_type = '{kind}'", "all_ev"))
    def _(spark, root, kind=kind):
        return only_type(R.all_events(spark, root), kind).select("event_id", "customer_id")


@query("fo7_one_customer", with_ctes("SELECT event_id FROM all_ev WHERE customer_id = '42'", "all_ev"))
def _(spark, root):
    return W.filter_by_customer(R.all_events(spark, root), " 42 ").select("event_id")


@query("fo8_one_product", with_ctes("SELECT event_id FROM all_ev WHERE product_id = 'p-7'", "all_ev"))
def _(spark, root):
    return W.filter_by_product(R.all_events(spark, root), "p-7").select("event_id")
