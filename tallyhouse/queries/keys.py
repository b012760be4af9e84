"""Row keys, keyed tables, date and JSON expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext
from ..functions import rowkeys as K
from ..functions import timestamps as TM
from ..schemas import struct
from ..session import scratch
from ..sinks.keyed import KeyedTable
from ..sources import relational as R
from .base import amount, dbl, query, step, with_ctes

COMPACT = "strftime(event_timestamp, '%Y%m%d%H%M%S') || lpad(CAST(epoch_us(event_timestamp) % 1000000 AS VARCHAR), 6, '0')"
EPOCH = "CAST(epoch_us(event_timestamp) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(event_timestamp) % 1000000 AS VARCHAR), 6, '0')"
DAY_TEXT = "strftime(event_timestamp, '%Y%m%d')"

step("rk3_row_keys", R.activity_events,
     lambda df: df.withColumns({
         "event_key": K.event("event_type", "event_id"),
         "alert_key": K.alert(F.lit("late:order"), "event_id", "event_timestamp"),
         "sales_key": K.sales_metric("event_timestamp", F.lit(" product "), "product_id"),
         "customer_key": K.customer("customer_id"),
         "customer_time_key": K.customer("customer_id", "event_timestamp"),
         "product_key": K.product("product_id"),
         "product_time_key": K.product("product_id", "event_timestamp"),
         "prefixed_key": K.prefixed("p", "event_type", "cart_id"),
         "day_key": K.date("event_timestamp"),
         "time_key": K.timestamp("event_timestamp")}),
     {"event_key": "event_type || ':' || event_id",
      "alert_key": f"'late_order:' || event_id || ':' || {COMPACT}",
      "sales_key": f"{DAY_TEXT} || ':product:' || product_id",
      "customer_key": "'customer:' || customer_id",
      "customer_time_key": f"'customer:' || customer_id || ':' || {COMPACT}",
      "product_key": "'product:' || product_id",
      "product_time_key": f"'product:' || product_id || ':' || {COMPACT}",
      "prefixed_key": "'p:' || event_type || ':' || cart_id",
      "day_key": DAY_TEXT, "time_key": COMPACT}, "activity_ev")
step("rk7_delivery_keys", R.delivery_events,
     lambda df: df.withColumn("delivery_key", K.delivery_metric("event_timestamp", "carrier", "order_id")),
     {"delivery_key": f"{DAY_TEXT} || ':' || carrier || ':' || order_id"}, "delivery_ev")
step("rk1_alert_and_window_keys", R.activity_events,
     lambda df: df.withColumns({
         "alert_row": K.alert_row("event_id", F.lit("LATE_DELIVERY"), "event_timestamp"),
         "window_row": K.window_row("event_timestamp", "event_type", "cart_id")}),
     {"alert_row": f"{EPOCH} || '#LATE_DELIVERY#' || event_id",
      "window_row": f"'window#' || {EPOCH} || '#' || event_type || '#' || coalesce(cart_id, 'global')"}, "activity_ev")

# ---- keyed table ------------------------------------------------------------------------
ROW = struct("row_key STRING, kind STRING, amount DECIMAL(14,2), last_seen TIMESTAMP")


def loaded(spark, root) -> KeyedTable:
    """Customers upserted twice: first from order lines, then from the activity events;
    then one customer deleted and one column emptied."""
    table = KeyedTable(spark, scratch(spark, "keyed"), ROW)
    for version, source in enumerate((R.order_events, R.activity_events)):
        rows = source(spark, root).select(
            K.customer("customer_id").alias("row_key"), F.col("event_type").alias("kind"),
            F.col("total_amount").alias("amount"), F.col("event_timestamp").alias("last_seen"), "event_id", "product_id")
        table.upsert(rows, version, order_by=[F.desc("last_seen"), F.asc("event_id"), F.asc("amount"), F.asc("product_id")])
    keys = lambda *ids: spark.createDataFrame([(f"customer:{i}",) for i in ids], "row_key STRING")
    table.delete(keys("7"), 2)
    table.delete_columns(keys("8"), ["amount", "kind"], 3)
    return table


LATEST = """(SELECT 'customer:' || customer_id AS row_key,
  CASE WHEN customer_id = '8' THEN NULL ELSE event_type END AS kind,
  CASE WHEN customer_id = '8' THEN NULL ELSE total_cents END AS cents, event_timestamp AS last_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY v DESC, event_timestamp DESC, event_id, total_cents NULLS FIRST, product_id) AS rn
  FROM (SELECT *, 0 AS v FROM order_ev UNION ALL SELECT *, 1 AS v FROM activity_ev)) WHERE rn = 1 AND customer_id <> '7')"""
ROW_SQL = f"row_key, kind, {amount('cents')} AS amount, last_seen"


@query("kv3_upserted_rows", with_ctes(f"SELECT {ROW_SQL} FROM {LATEST}", "order_ev", "activity_ev"))
def _(spark, root):
    return loaded(spark, root).read()


@query("kv1_get_row", with_ctes(
    f"SELECT row_key, kind FROM {LATEST} WHERE row_key = 'customer:42'", "order_ev", "activity_ev"))
def _(spark, root):
    return loaded(spark, root).get("customer:42", ["kind"])


@query("kv2_scan_range", with_ctes(
    f"SELECT {ROW_SQL} FROM {LATEST} WHERE row_key >= 'customer:2' AND row_key < 'customer:5' ORDER BY row_key LIMIT 50",
    "order_ev", "activity_ev"))
def _(spark, root):
    return loaded(spark, root).scan("customer:2", "customer:5", limit=50)


@query("kv4_compacted_table", with_ctes(f"SELECT {ROW_SQL} FROM {LATEST}", "order_ev", "activity_ev"))
def _(spark, root):
    return loaded(spark, root).compact_into(scratch(spark, "compact")).read()


# ---- dates --------------------------------------------------------------------------------
T0 = "event_timestamp"
step("dt4_day_and_hour_bounds", R.activity_events,
     lambda df: df.withColumns({
         "day_start": TM.start_of_day(T0), "day_end": TM.end_of_day(T0), "hour_start": TM.start_of_hour(T0),
         "hour_end": TM.end_of_hour(T0), "plus_seconds": TM.add_seconds(T0, 90.5), "plus_minutes": TM.add_minutes(T0, 5),
         "plus_hours": TM.add_hours(T0, -3), "plus_days": TM.add_days(T0, 30),
         "gap": TM.difference_seconds(T0, "ingestion_timestamp"), "late": TM.is_late(T0, "ingestion_timestamp")}),
     {"day_start": f"date_trunc('day', {T0})::TIMESTAMP", "day_end": f"date_trunc('day', {T0})::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND",
      "hour_start": f"date_trunc('hour', {T0})", "hour_end": f"date_trunc('hour', {T0}) + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND",
      "plus_seconds": f"{T0} + INTERVAL 90500 MILLISECOND", "plus_minutes": f"{T0} + INTERVAL 5 MINUTE",
      "plus_hours": f"{T0} - INTERVAL 3 HOUR", "plus_days": f"{T0} + INTERVAL 30 DAY",
      "gap": f"{dbl('epoch_us(ingestion_timestamp) - epoch_us(event_timestamp)')} / 1000000",
      "late": f"ingestion_timestamp > {T0}"}, "activity_ev")


def texted_times(spark, root):
    df = R.activity_events(spark, root)
    iso = F.date_format(T0, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.withColumns({
        "with_z": F.concat(F.lit(" "), iso, F.lit("Z ")), "with_offset": F.concat(iso, F.lit("-03:00")),
        "day_text": F.date_format(T0, "yyyy-MM-dd"), "junk": F.concat(F.lit("on "), iso)})


step("dt2_parsed_times", texted_times,
     lambda df: df.withColumns({
         "from_z": TM.parse_datetime("with_z"), "from_offset": TM.parse_datetime("with_offset"),
         "day": TM.parse_date("day_text"), "bad_time": TM.parse_datetime("junk"), "bad_day": TM.parse_date("junk"),
         "local_noon": TM.to_utc(T0, "America/Sao_Paulo")}),
     {"from_z": T0, "from_offset": f"{T0} + INTERVAL 3 HOUR", "day": f"CAST({T0} AS DATE)", "bad_time": "CAST(NULL AS TIMESTAMP)",
      "bad_day": "CAST(NULL AS DATE)", "local_noon": f"{T0} + INTERVAL 3 HOUR"}, "activity_ev")

# ---- JSON -----------------------------------------------------------------------------------
@query("js3_valid_json",
       "SELECT event_id, true AS good, false AS cut, false AS blank, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, root):
    df = R.table(spark, root, "events")
    parsed = jsontext.loads("props", "k INT")
    return df.select(
        "event_id", jsontext.validate("props").alias("good"),
        jsontext.validate(F.expr("substring(props, 1, 4)")).alias("cut"), jsontext.validate(F.lit(" ")).alias("blank"),
        parsed["k"].alias("k"))


@query("js1_dump_json", with_ctes(
    "SELECT '{\"event_id\":\"' || event_id || '\",\"event_timestamp\":\"' || strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.') || "
    "lpad(CAST(epoch_us(event_timestamp) % 1000000 AS VARCHAR), 6, '0') || 'Z\",\"cart_id\":' || "
    "coalesce('\"' || cart_id || '\"', 'null') || '}' AS payload FROM activity_ev", "activity_ev"))
def _(spark, root):
    return R.activity_events(spark, root).select(
        jsontext.dumps("event_id", "event_timestamp", "cart_id").alias("payload"))
