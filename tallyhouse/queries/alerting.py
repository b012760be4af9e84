"""Alert rules, questions on alert tables, and metric tables."""

from __future__ import annotations

import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.guarded import guard
from ..functions.predicates import is_late_event
from ..operators import alerts as A
from ..operators import metrics as M
from ..operators import refine
from ..operators import sketches as K
from ..operators import windows as W
from ..schemas import struct
from ..session import scratch
from ..sinks.keyed import KeyedTable
from ..sources import relational as R
from ..streaming import sinks
from .activity import window_sql
from .base import amount, query, with_ctes
from .scans import rough_events

ALERT_OUT = ["alert_id", "alert_type", "event_timestamp", "severity", "message", "event_type", "customer_id", "product_id", "metrics"]
MONEY_TEXT = "(total_cents // 100) || '.' || lpad(CAST(total_cents % 100 AS VARCHAR), 2, '0')"
DELAY = "((epoch_us(ingestion_timestamp) - epoch_us(event_timestamp)) // 1000000)"
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.000000Z')"
LARGE = (
    "SELECT 'alert-order-' || event_id AS alert_id, 'LARGE_ORDER_VALUE' AS alert_type, event_timestamp, 'HIGH' AS severity, "
    f"'Pedido com valor acima do limite: ' || {MONEY_TEXT} || '.' AS message, event_type, customer_id, product_id, "
    f"'order_id=' || coalesce(order_id, '') || ';threshold=10000.00;total_amount=' || {MONEY_TEXT} AS metrics, "
    f"'{{\"total_amount\":\"' || {MONEY_TEXT} || '\",\"threshold\":\"10000.00\",\"order_id\":\"' || order_id || '\"}}' AS payload, "
    "event_id FROM all_ev WHERE event_type = 'order' AND total_cents >= 1000000"
)
LATE = (
    "SELECT 'alert-delivery-' || event_id AS alert_id, 'LATE_DELIVERY' AS alert_type, event_timestamp, 'WARNING' AS severity, "
    "'Entrega apresenta atraso superior a 24 horas.' AS message, event_type, customer_id, CAST(NULL AS VARCHAR) AS product_id, "
    f"'carrier=' || carrier || ';delay_seconds=' || {DELAY} || ';delivery_id=' || delivery_id || ';order_id=' || order_id || "
    "';threshold_seconds=86400' AS metrics, "
    f"'{{\"delay_seconds\":\"' || {DELAY} || '\",\"threshold_seconds\":\"86400\",\"order_id\":\"' || order_id || '\",\"delivery_id\":\"' "
    "|| delivery_id || '\",\"carrier\":\"' || carrier || '\"}' AS payload, "
    "event_id FROM all_ev WHERE event_type = 'delivery' AND status NOT IN ('delivered', 'failed') "
    "AND ingestion_timestamp - event_timestamp > INTERVAL 24 HOUR"
)
ALERTS = f"({LARGE} UNION ALL {LATE})"
SHOWN = ", ".join(ALERT_OUT)


def alerts(spark, root):
    return A.detect(R.all_events(spark, root))


def orders_per_window(spark, root):
    """Hourly windows over the order lines: those of a day share its midnight."""
    return W.process(R.order_events(spark, root), 3600, 3600, ordered=False)


WINDOWS = window_sql("order_ev", None, 3600, 3600)


@query("al1_sales_volume_alerts", WINDOWS.replace(
    "SELECT * EXCLUDE (kind, types), kind AS event_type FROM",
    "SELECT 'alert-sales-' || (epoch_us(window_end) // 1000000) || '.0' AS alert_id, 'HIGH_SALES_VOLUME' AS alert_type, "
    "window_end AS event_timestamp, 'WARNING' AS severity, 'Volume de vendas acima do limite: ' || event_count || "
    "' eventos.' AS message, 'order' AS event_type, CAST(NULL AS VARCHAR) AS customer_id, CAST(NULL AS VARCHAR) AS product_id, 'event_count=' || event_count || ';threshold=30;window_end=' || "
    + ISO.format("window_end") + " || ';window_start=' || " + ISO.format("window_start") + " AS metrics FROM")
    + " WHERE event_count >= 30 AND kind IN ('order', 'mixed')")
def _(spark, root):
    return A.detect_window(orders_per_window(spark, root), A.window_rules(30)).select(*ALERT_OUT)


@query("al2_large_order_alerts", with_ctes(f"SELECT {SHOWN} FROM ({LARGE})", "all_ev"))
def _(spark, root):
    return A.detect(R.all_events(spark, root), [A.large_order_value()]).select(*ALERT_OUT)


@query("al3_late_delivery_alerts", with_ctes(f"SELECT {SHOWN} FROM ({LATE})", "all_ev"))
def _(spark, root):
    return A.detect(R.all_events(spark, root), [A.late_delivery()]).select(*ALERT_OUT)


@query("al5_all_event_alerts", with_ctes(f"SELECT {SHOWN} FROM {ALERTS}", "all_ev"))
def _(spark, root):
    rules = A.register_rule(A.register_rule([], A.large_order_value()), A.late_delivery())
    return A.detect_batch(R.all_events(spark, root), rules).select(*ALERT_OUT)


def fragile_rules():
    """Two of the contract's rules, and two that fail on some rows: a price per piece, and the numbers inside an id."""
    price = guard(F.col("total_amount").cast("double")) / (F.col("quantity") - 13)
    number = guard(F.split("event_id", "-")).item(3).cast("int")
    line = {
        "alert_id": F.concat(F.lit("line-"), F.col("event_id")),
        "event_timestamp": F.col("event_timestamp"),
        "message": number.map(lambda n: F.concat(F.lit("line "), n.cast("string"))),
        "event_type": F.col("event_type"),
    }
    dear = {**line, "alert_id": F.concat(F.lit("price-"), F.col("event_id")), "message": F.lit("price")}
    return [
        A.AlertRule("PRICE", "INFO", price > 5000.0, dear),
        *A.event_rules(),
        A.AlertRule("LINE", "INFO", F.col("quantity") >= 5, line),
    ]


ORDER_LINE = "event_id LIKE 'o-%'"
DEAR = "CAST(total_cents AS DOUBLE) / 100 / nullif(quantity - 13, 0) > 5000"


@query("al5_failing_rules", with_ctes(
    f"SELECT alert_id, alert_type, CAST(NULL AS VARCHAR) AS error FROM {ALERTS} "
    f"UNION ALL SELECT 'price-' || event_id, 'PRICE', NULL FROM all_ev WHERE {DEAR} "
    "UNION ALL SELECT event_id, 'PRICE', 'division by zero' FROM all_ev WHERE quantity = 13 AND total_cents IS NOT NULL "
    f"UNION ALL SELECT 'line-' || event_id, 'LINE', NULL FROM all_ev WHERE quantity >= 5 AND {ORDER_LINE} "
    f"UNION ALL SELECT event_id, 'LINE', 'no item 3' FROM all_ev WHERE quantity >= 5 AND NOT ({ORDER_LINE})", "all_ev"))
def _(spark, root):
    """Alerts of all rules, and the rows on which a rule failed: the other alerts of these rows stand."""
    found = A.outcomes(R.all_events(spark, root), fragile_rules(), "event_id")
    return found.select(F.coalesce("alert_id", "event_id").alias("alert_id"), "alert_type", "error")


@query("al8_has_alerts", with_ctes(
    "SELECT event_id, (event_type = 'order' AND coalesce(total_cents >= 1000000, false)) OR (event_type = 'delivery' AND "
    "status NOT IN ('delivered', 'failed') AND ingestion_timestamp - event_timestamp > INTERVAL 24 HOUR) AS has_alerts "
    "FROM all_ev", "all_ev"))
def _(spark, root):
    return A.has_alerts(R.all_events(spark, root), A.event_rules()).select("event_id", "has_alerts")


@query("al9_alert_count", with_ctes(f"SELECT count(*) AS alert_count FROM {ALERTS}", "all_ev"))
def _(spark, root):
    return A.count_alerts(R.all_events(spark, root))


# ---- questions on the alert table -----------------------------------------------------
def graded(spark, root):
    """The alerts with monitoring severities: large orders are critical."""
    level = F.when(F.col("alert_type") == A.LARGE_ORDER_VALUE, "CRITICAL").otherwise(F.col("severity"))
    return alerts(spark, root).withColumn("severity", level)


GRADED = f"(SELECT * REPLACE (CASE WHEN alert_type = 'LARGE_ORDER_VALUE' THEN 'CRITICAL' ELSE severity END AS severity) FROM {ALERTS})"


@query("aq1_alerts_of_type", with_ctes(f"SELECT alert_id FROM {GRADED} WHERE alert_type = 'LATE_DELIVERY'", "all_ev"))
def _(spark, root):
    return A.filter_by_type(graded(spark, root), A.LATE_DELIVERY).select("alert_id")


@query("aq3_critical_alerts", with_ctes(f"SELECT alert_id FROM {GRADED} WHERE severity = 'CRITICAL'", "all_ev"))
def _(spark, root):
    return A.critical_alerts(graded(spark, root)).select("alert_id")


@query("aq4_warning_alerts", with_ctes(f"SELECT alert_id FROM {GRADED} WHERE severity = 'WARNING'", "all_ev"))
def _(spark, root):
    return A.warning_alerts(graded(spark, root)).select("alert_id")


@query("aq5_alert_total", with_ctes(f"SELECT count(*) AS alert_count FROM {GRADED}", "all_ev"))
def _(spark, root):
    return A.count(graded(spark, root))


@query("aq6_alerts_by_severity", with_ctes(
    f"SELECT s AS severity, count(*) FILTER (lower(severity) = s) AS alert_count FROM {GRADED}, "
    "(SELECT unnest(['info', 'warning', 'critical']) AS s) GROUP BY s", "all_ev"))
def _(spark, root):
    return A.count_by_severity(graded(spark, root))


@query("aq7_new_alerts", with_ctes(
    f"SELECT DISTINCT alert_id FROM {GRADED} WHERE alert_id NOT IN (SELECT alert_id FROM {GRADED} "
    "WHERE event_timestamp < TIMESTAMP '1998-01-01')", "all_ev"))
def _(spark, root):
    found = graded(spark, root)
    return A.new_alerts(found, found.filter(F.col("event_timestamp") < "1998-01-01")).select("alert_id")


@query("aq8_alerts_summary", with_ctes(
    "SELECT count(*) AS total, count(*) FILTER (severity = 'INFO') AS info, count(*) FILTER (severity = 'WARNING') AS warning, "
    "count(*) FILTER (severity = 'CRITICAL') AS critical, string_agg(DISTINCT alert_type, ',' ORDER BY alert_type) AS types "
    f"FROM {GRADED}", "all_ev"))
def _(spark, root):
    return A.alerts_summary(graded(spark, root))


@query("aq9_recent_alerts", with_ctes(
    f"SELECT alert_id, event_timestamp FROM {GRADED} ORDER BY event_timestamp DESC, alert_id LIMIT 10", "all_ev"))
def _(spark, root):
    return A.recent_alerts(graded(spark, root)).select("alert_id", "event_timestamp")


@query("snk15_serialized_alerts", with_ctes(
    "SELECT (epoch_us(event_timestamp) // 1000000) || '.000000#' || alert_type || '#' || alert_id AS row_key, alert_id, alert_type, "
    "severity, message, event_type, customer_id, coalesce(product_id, '') AS product_id, "
    f"strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.000000Z') AS event_timestamp, payload AS metrics FROM {ALERTS}", "all_ev"))
def _(spark, root):
    return A.serialize(alerts(spark, root)).drop("detected_at")


# ---- metrics ------------------------------------------------------------------------------
def feed_metrics(spark, root):
    """Deltas of the feed's counters, one row per event."""
    events = R.activity_events(spark, root)
    name = F.concat(F.lit("batch_"), F.col("event_type"))
    tags = F.create_map(F.lit("page"), F.coalesce("page", F.lit("")))
    return M.record(events, name, F.coalesce("quantity", F.lit(1)), "ingestion_timestamp", tags=tags)


METRICS = (
    "(SELECT 'batch_' || event_type AS name, CAST(coalesce(quantity, 1) AS DOUBLE) AS value, "
    "ingestion_timestamp AS timestamp, coalesce(page, '') AS page FROM activity_ev)"
)


@query("mt1_recorded_metrics", with_ctes(f"SELECT name, value, timestamp, 'count' AS unit, page, 'page=' || page AS tags FROM {METRICS}", "activity_ev"))
def _(spark, root):
    return feed_metrics(spark, root).withColumn("page", F.col("tags")["page"])


@query("mt2_counters", with_ctes(
    f"SELECT name, sum(value) AS value, max(timestamp) AS timestamp FROM {METRICS} GROUP BY ALL", "activity_ev"))
def _(spark, root):
    return M.increment(feed_metrics(spark, root))


@query("mt3_latency", with_ctes(
    "SELECT event_type AS name, count(*) AS samples, CAST(CAST(sum(epoch_us(ingestion_timestamp) - epoch_us(event_timestamp)) AS BIGINT) // 1000 AS DOUBLE) / count(*) AS mean_ms, "
    "CAST(max(epoch_us(ingestion_timestamp) - epoch_us(event_timestamp)) AS DOUBLE) / 1000 AS max_ms, " + ", ".join(
        f"CAST(quantile_disc(epoch_us(ingestion_timestamp) - epoch_us(event_timestamp), {p}) AS DOUBLE) / 1000 AS p{p * 100:.0f}"
        for p in (0.5, 0.95, 0.99)) + " FROM activity_ev GROUP BY ALL",
    "activity_ev"))
def _(spark, root):
    ms = (F.unix_micros("ingestion_timestamp") - F.unix_micros("event_timestamp")) / 1000
    samples = M.observe_latency(
        R.activity_events(spark, root), F.col("event_type"), ms, "ingestion_timestamp")
    points = [F.col("percentiles")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))]
    return M.exact_latency_summary(samples).select("name", "samples", "mean_ms", "max_ms", *points)


def latency_samples(spark, root):
    ms = (F.unix_micros("ingestion_timestamp") - F.unix_micros("event_timestamp")) / 1000
    return M.observe_latency(R.all_events(spark, root), F.col("event_type"), ms, "ingestion_timestamp")


LATENCY_US = "(epoch_us(ingestion_timestamp) - epoch_us(event_timestamp))"


@query("mt3_latency_sketches", with_ctes(
    "SELECT date_trunc('year', ingestion_timestamp)::TIMESTAMP AS year, event_type AS name, count(*) AS samples, "
    f"CAST(CAST(sum({LATENCY_US}) AS BIGINT) // 1000 AS DOUBLE) / count(*) AS mean_ms, "
    f"CAST(max({LATENCY_US}) AS DOUBLE) / 1000 AS max_ms, true AS p50_close, true AS p95_close, true AS p99_close "
    f"FROM all_ev WHERE {LATENCY_US} >= 0 GROUP BY ALL", "all_ev"))
def _(spark, root):
    """Sketches stored per day and merged per year, next to the exact ranks of what they report.

    A value is close within twice the error of one sketch.
    """
    path = scratch(spark, "latencies")
    samples = latency_samples(spark, root)
    K.daily_latencies(samples).write.parquet(path)
    year = lambda c: F.date_trunc("year", c).alias("year")
    report = K.latency_report(K.merged_latencies(spark.read.parquet(path), year("day")))
    errors = K.rank_errors(report, samples.select("*", year("timestamp")), ["year"])
    close = [(F.col(f"{p}_error") <= 2 * K.RANK_ERROR).alias(f"{p}_close") for p in K.POINTS]
    return report.drop(*K.POINTS).join(errors, ["year", "name"]).select(
        "year", "name", "samples", "mean_ms", "max_ms", *close)


CUSTOMERS_SQL = "count(DISTINCT customer_id)"


@query("sa8_sketched_customers", with_ctes(
    "SELECT strftime(event_timestamp, '%Y') AS year, event_type, count(*) AS event_count, true AS close, "
    f"CASE WHEN {CUSTOMERS_SQL} <= 4096 THEN {CUSTOMERS_SQL} END AS counted FROM all_ev GROUP BY ALL", "all_ev"))
def _(spark, root):
    """Customer sets stored per day and type, united per year: exact up to the size of a sketch, close beyond."""
    path, events = scratch(spark, "customer_sets"), R.all_events(spark, root)
    K.customer_sets(events, F.to_date("event_timestamp").alias("day"), "event_type").write.parquet(path)
    year = lambda c: F.date_format(c, "yyyy").alias("year")
    sizes = K.set_sizes(K.united_sets(spark.read.parquet(path), year("day"), "event_type"))
    exact = events.groupBy(year("event_timestamp"), "event_type").agg(F.count_distinct("customer_id").alias("_exact"))
    estimate, truth = F.col("unique_customers"), F.col("_exact")
    return sizes.join(exact, ["year", "event_type"]).select(
        "year", "event_type", "event_count", (F.abs(estimate - truth) <= K.SET_ERROR * truth).alias("close"),
        F.when(truth <= 2**K.SET_SIZE_LOG2, estimate).alias("counted"))


SNAPSHOT = (
    f"SELECT name, value, timestamp, 'count' AS unit FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY timestamp DESC, "
    f"value DESC) AS rn FROM {METRICS}) WHERE rn = 1"
)


@query("mt5_latest_metrics", with_ctes(SNAPSHOT, "activity_ev"))
def _(spark, root):
    return M.snapshot(feed_metrics(spark, root))


@query("mt4_one_metric", with_ctes(f"SELECT name, value FROM ({SNAPSHOT}) WHERE name = 'batch_cart'", "activity_ev"))
def _(spark, root):
    return M.get_value(feed_metrics(spark, root), "batch_cart")


# ---- summaries of a real run ------------------------------------------------------------
def counters(spark, values: dict):
    """Counters as rows of the metric table."""
    moment = F.lit("2024-02-01").cast("timestamp")
    rows = spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name STRING, value DOUBLE")
    return M.record(rows, F.col("name"), F.col("value"), moment)


def cleaned_run(spark, root):
    """The damaged feed is cleaned and written; what is counted comes from that one pass."""
    received, kept = Observation(), Observation()
    late = F.sum(F.when(is_late_event(), 1).otherwise(0)).alias("late")
    raw = refine.normalize_columns(rough_events(spark, root)).observe(received, F.count(F.lit(1)).alias("n"), late)
    clean = refine.clean(raw).observe(kept, F.count(F.lit(1)).alias("n"))
    path = scratch(spark, "cleaned")
    clean.write.parquet(path)
    return received.get, kept.get["n"], spark.read.schema(clean.schema).parquet(path)


def summary_sql(names, values: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"CAST({values.get(n, 'NULL')} AS DOUBLE) AS {n}" for n in names)


RECEIVED, CLEANED = "(SELECT count(*) FROM rough_ev)", "(SELECT count(*) FROM clean_ev)"


@query("mt6_processing_summary", with_ctes(summary_sql(M.PROCESSING, {
    "events_received": RECEIVED, "events_processed": CLEANED, "events_filtered": f"{RECEIVED} - {CLEANED}",
    "events_late": "(SELECT count(*) FROM rough_ev WHERE ingestion_timestamp > event_timestamp)"}), "clean_ev"))
def _(spark, root):
    received, kept, _ = cleaned_run(spark, root)
    return M.processing_summary(counters(spark, {
        "events_received": received["n"], "events_processed": kept,
        "events_filtered": received["n"] - kept, "events_late": received["late"]}))


@query("mt8_batch_summary", with_ctes(summary_sql(M.BATCH, {
    "batch_jobs_started": "1", "batch_jobs_completed": "1", "batch_jobs_failed": "0",
    "batch_records_processed": CLEANED}), "clean_ev"))
def _(spark, root):
    _, kept, _ = cleaned_run(spark, root)
    return M.batch_summary(counters(spark, {
        "batch_jobs_started": 1, "batch_jobs_completed": 1, "batch_jobs_failed": 0, "batch_records_processed": kept}))


@query("mt9_storage_summary", with_ctes(summary_sql(M.STORAGE, {
    "hdfs_written_records": CLEANED, "hdfs_read_records": CLEANED,
    "hbase_written_records": "(SELECT count(DISTINCT event_id) FROM clean_ev)",
    "hbase_read_records": "(SELECT count(DISTINCT event_id) FROM clean_ev)"}), "clean_ev"))
def _(spark, root):
    _, kept, back = cleaned_run(spark, root)
    table = KeyedTable(spark, scratch(spark, "keyed"), struct("row_key STRING, event_type STRING"))
    table.upsert(back.select(F.col("event_id").alias("row_key"), "event_type"), 0)
    return M.storage_summary(counters(spark, {
        "hdfs_written_records": kept, "hdfs_read_records": back.count(),
        "hbase_written_records": table.log().count(), "hbase_read_records": table.read().count()}))


@query("mt7_streaming_summary", with_ctes(summary_sql(M.STREAMING, {
    "streaming_events_received": "(SELECT count(*) FROM activity_ev)",
    "streaming_alerts_generated": "(SELECT count(*) FROM activity_ev WHERE event_type = 'order' AND total_cents >= 5000)",
    "streaming_events_late": "0"}), "activity_ev"))
def _(spark, root):
    """An alert stream is run to its end; a listener counts its progress reports."""
    path, reports = scratch(spark, "streamed"), M.ProgressCounters()
    spark.streams.addListener(reports)
    try:
        table = sinks.alert_table(spark, f"{path}/table")
        found = A.detect(R.activity_stream(spark, root), [A.large_order_value("50.00")])
        stream = sinks.start_keyed(found, table, A.serialize, f"{path}/checkpoint")
        stream.awaitTermination()
        for _ in range(300):
            if reports.ended(str(stream.id)):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(reports)
    totals = reports.totals(str(stream.id))
    return M.streaming_summary(counters(spark, {
        "streaming_events_received": totals["streaming_events_received"],
        "streaming_events_late": totals["streaming_events_late"],
        "streaming_alerts_generated": table.read().count()}))
