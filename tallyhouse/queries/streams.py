"""Structured Streaming queries: the activity feed is streamed from its files, run with
``availableNow`` into the shared scratch folder, and read back."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import dump_row
from ..operators import alerts as A
from ..session import FREE_SHUFFLES, ONE_VERSION, scratch, settings
from ..sources import relational as R
from ..sinks.rolled import RolledArchive
from ..streaming import clocks, job, late, run, sinks, sources
from .activity import ARRIVED, shuffled_arrivals, window_sql
from .alerting import ALERTS
from .base import amount, flag, query, with_ctes
from .scans import CONTRACT_OK, CORE_SQL, core, files_for

CLOSED = "window_end <= (SELECT max(event_timestamp) - INTERVAL 10 SECOND FROM activity_ev)"


def finish(query_handle):
    query_handle.awaitTermination()
    if query_handle.exception() is not None:
        raise query_handle.exception()


def to_parquet(spark, frame, name):
    """Run a stream to its end into a Parquet folder and read the folder back."""
    path = scratch(spark, name)
    finish(sinks.start_parquet(frame, f"{path}/out", f"{path}/checkpoint"))
    return spark.read.schema(frame.schema).parquet(f"{path}/out")


def json_folder(spark, root, files=4, source=R.activity_events):
    """The feed as JSON lines in several parts of as many files as the rows ask for, in arrival order.

    Returns the folder and the number of files of a part.
    """
    path, each = scratch(spark, "feed"), files_for(spark, root, files)
    df = source(spark, root)
    # rows without an arrival stand at their event time, and not all in one file
    arrival = F.coalesce("ingestion_timestamp", "event_timestamp")
    ordered = df.repartitionByRange(files * each, arrival).sortWithinPartitions(arrival)
    ordered.select(dump_row(df.drop("metadata")).alias("value")).write.text(path)
    return path, each


@query("st1_stream_parsed_lines", with_ctes(f"SELECT {CORE_SQL} FROM activity_ev", "activity_ev"))
def _(spark, root):
    feed, each = json_folder(spark, root)
    lines = sources.read_lines(spark, feed, max_files_per_trigger=2 * each)
    return to_parquet(spark, core(sources.parse(lines)), "parsed")


@query("st2_stream_valid_events", with_ctes(
    f"SELECT {CORE_SQL} FROM activity_ev WHERE NOT (event_type = 'cart' AND quantity > 8)", "activity_ev"))
def _(spark, root):
    events = R.activity_stream(spark, root)
    holes = events.withColumn(
        "customer_id",
        F.when((F.col("event_type") == "cart") & (F.col("quantity") > 8), F.lit(" ")).otherwise(F.col("customer_id")))
    return to_parquet(spark, core(sources.valid(holes)), "valid")


def carts_without_arrival(spark, root):
    """The activity feed from a producer that sends carts without an ingestion time."""
    brought = F.when(F.col("event_type") != "cart", F.col("ingestion_timestamp"))
    return R.activity_events(spark, root).withColumn("ingestion_timestamp", brought)


@query("src10_stream_of_files", with_ctes(
    "SELECT " + CORE_SQL.replace(
        "ingestion_timestamp", "CASE WHEN event_type <> 'cart' THEN ingestion_timestamp END AS ingestion_timestamp")
    + f", {flag("event_type = 'cart'")} AS stamped FROM activity_ev", "activity_ev"))
def _(spark, root):
    """A row without an ingestion time gets that of its micro-batch, after the query began; others keep theirs."""
    began = F.lit(datetime.now(timezone.utc) - timedelta(seconds=5))
    feed, each = json_folder(spark, root, source=carts_without_arrival)
    events = sources.read_stream(spark, feed, max_files_per_trigger=each)
    stamped = F.col("ingestion_timestamp") >= began
    out = to_parquet(spark, core(sources.stamp_ingestion(events)), "files").withColumn(
        "stamped", F.when(stamped, 1).otherwise(0))
    return out.withColumn("ingestion_timestamp", F.when(F.col("stamped") == 0, F.col("ingestion_timestamp")))


@query("src17_stream_validated", with_ctes(f"SELECT {CORE_SQL} FROM activity_ev {CONTRACT_OK}", "activity_ev"))
def _(spark, root):
    from .scans import contract_lines, written_lines

    good, _bad = sources.read_validated(spark, written_lines(spark, root, contract_lines))
    return to_parquet(spark, core(good), "validated")


SLIDING = window_sql("activity_ev", "customer_id")


@query("st7_stream_customer_windows", SLIDING.replace(
    "SELECT * EXCLUDE (kind, types), kind AS event_type FROM", "SELECT window_start, window_end, key AS customer_id, event_count, "
    "unique_customers, total_quantity, total_amount, types AS event_types FROM") + f" WHERE {CLOSED}")
def _(spark, root):
    windows = job.customer_windows(R.activity_stream(spark, root))
    return to_parquet(spark, windows, "windows")


@query("st6_stream_overall_windows", window_sql("activity_ev").replace(
    "SELECT * EXCLUDE (kind, types), kind AS event_type FROM", "SELECT window_start, window_end, kind AS event_type, event_count, "
    "unique_customers, total_quantity, total_amount, 'event_types=[\"' || replace(types, ',', '\",\"') || '\"]' AS metadata FROM") + f" WHERE {CLOSED}")
def _(spark, root):
    windows = job.as_window_result(job.overall_windows(R.activity_stream(spark, root)))
    return to_parquet(spark, windows, "overall").drop("key")


@query("st6_stream_sketched_windows", window_sql("activity_ev").replace(
    "SELECT * EXCLUDE (kind, types), kind AS event_type FROM", "SELECT window_start, window_end, event_count, "
    "unique_customers, total_quantity, total_amount, types AS event_types FROM") + f" WHERE {CLOSED}")
def _(spark, root):
    """A window of these feeds has far fewer customers than a sketch holds, so the counts are exact."""
    return to_parquet(spark, job.sketched_windows(R.activity_stream(spark, root)), "sketched")


@query("st6_stream_type_windows", window_sql("activity_ev", "event_type").replace(
    "SELECT * EXCLUDE (kind, types), kind AS event_type FROM", "SELECT window_start, window_end, key AS event_type, event_count, "
    "unique_customers, total_quantity, total_amount, types AS event_types FROM") + f" WHERE {CLOSED}")
def _(spark, root):
    windows = job.overall_windows(R.activity_stream(spark, root), by="event_type")
    return to_parquet(spark, windows, "by_type")


#: Events of one part of the activity feed; its panes and windows are the state of a stream at any time.
PART_EVENTS = 2_000_000


def timed_parts(spark, root, path):
    """The activity table in parts of increasing event time that lie in a folder one after the other; yields a stream of the folder for each.

    A stream that keeps its checkpoint takes each part before the next one replaces it. No row of a part is older than
    those of the parts before, so none is late and the windows that a part has closed leave the state with it.
    Rows without a time are in the first part.
    """
    events = R.table(spark, root, "events")
    moment, parts = F.unix_micros(F.col("ts").cast("timestamp")), -(-events.count() // PART_EVENTS)
    at = [F.percentile_approx(moment, [i / parts for i in range(1, parts)], 10_000)] if parts > 1 else []
    cuts = sorted(set((events.agg(*at).first()[0] or []) if at else []))
    for low, high in zip((None, *cuts), (*cuts, None)):
        # cuts as literals of the column's type, so that they reach the scan
        cut = lambda us: F.timestamp_micros(F.lit(us)).cast(events.schema["ts"].dataType)
        part = events if low is None else events.filter(F.col("ts") >= cut(low))
        part = part if high is None else part.filter((F.col("ts") < cut(high)) | (F.col("ts").isNull() if low is None else F.lit(False)))
        part.write.mode("overwrite").parquet(path)
        yield R.activity_from(spark.readStream.schema(events.schema).parquet(path))


@query("snk14_stream_keyed_windows", SLIDING.replace(
    "SELECT * EXCLUDE (kind, types), kind AS event_type FROM", "SELECT 'window#' || (epoch_us(window_start) // 1000000) || '.000000#' || kind "
    "|| '#' || key AS row_key, 'WINDOW_AGGREGATION' AS alert_type, 'INFO' AS severity, kind AS event_type, "
    "strftime(window_end, '%Y-%m-%dT%H:%M:%S') AS ends, event_count AS events, unique_customers AS customers, total_quantity AS quantity, "
    "total_amount AS amount, types AS types FROM") + f" WHERE {CLOSED}")
def _(spark, root):
    path = scratch(spark, "keyed_windows")
    table = sinks.alert_table(spark, f"{path}/table")
    for events in timed_parts(spark, root, scratch(spark, "feed")):
        windows = job.as_window_result(job.customer_windows(events), F.col("customer_id"))
        with settings(spark, ONE_VERSION):
            finish(sinks.start_keyed(windows, table, sinks.window_rows, f"{path}/checkpoint", unique=True))
    stored = F.from_json("metrics", "event_count BIGINT, unique_customers BIGINT, total_quantity BIGINT, "
                         "total_amount STRING, metadata MAP<STRING, STRING>")
    # a stream in append mode writes each window once, when it is closed
    rows = table.read(unique=True).withColumn("_m", stored)
    types = F.from_json(F.col("_m.metadata")["event_types"], "ARRAY<STRING>")
    return rows.select(
        "row_key", "alert_type", "severity", "event_type", F.substring("event_timestamp", 1, 19).alias("ends"),
        F.col("_m.event_count").alias("events"), F.col("_m.unique_customers").alias("customers"),
        F.col("_m.total_quantity").alias("quantity"), F.col("_m.total_amount").cast("double").alias("amount"), types.alias("types"))


@query("snk12_stream_alerts", with_ctes(
    "SELECT 'alert-order-' || event_id AS alert_id, customer_id, product_id FROM activity_ev "
    "WHERE event_type = 'order' AND total_cents >= 5000", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "keyed_alerts")
    table = sinks.alert_table(spark, f"{path}/table")
    found = A.detect(R.activity_stream(spark, root), [A.large_order_value("50.00"), A.late_delivery()])
    finish(sinks.start_keyed(found, table, A.serialize, f"{path}/checkpoint"))
    return table.read().select("alert_id", "customer_id", "product_id")


@query("snk18_stream_archive", with_ctes(
    "SELECT strftime(event_timestamp, '%Y-%m-%d-%H') AS hour, count(*) AS events, "
    f"{amount('CAST(sum(coalesce(total_cents, 0)) AS BIGINT)')} AS amount FROM activity_ev GROUP BY ALL", "activity_ev"))
def _(spark, root):
    path = scratch(spark, "archive")
    finish(sinks.start_archive(
        R.activity_stream(spark, root), f"{path}/out", "event_timestamp", f"{path}/checkpoint", availableNow=True))
    back = spark.read.schema("value STRING, ano STRING, mes STRING, dia STRING, hora STRING").text(f"{path}/out")
    money = F.get_json_object("value", "$.total_amount").cast("decimal(14,2)")
    return back.groupBy(F.concat_ws("-", "ano", "mes", "dia", "hora").alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(money), F.lit(0)).cast("double").alias("amount"))


#: Days of arrival at which the feed below is cut; each part becomes one micro-batch.
CUTS = ("2024-01-07", "2024-01-13", "2024-01-19", "2024-01-25")
PART = " + ".join(f"CAST(ingestion_timestamp >= TIMESTAMP '{c}' AS INT)" for c in CUTS)


@query("wn14_stream_lateness", with_ctes(
    f"SELECT event_id, b AS batch, CASE WHEN event_timestamp < w - INTERVAL 10 SECOND THEN 'dropped' "
    "WHEN event_timestamp < w THEN 'allowed' ELSE 'on_time' END AS lateness FROM ("
    "SELECT a.*, (SELECT max(m) FROM (SELECT b, max(event_timestamp) AS m FROM a GROUP BY b) x WHERE x.b < a.b) "
    "- INTERVAL 10 SECOND AS w FROM a)", "activity_ev").replace(
        "\nSELECT event_id, b AS batch", f",\na AS (SELECT *, CAST({PART} AS BIGINT) AS b FROM {ARRIVED})\nSELECT event_id, b AS batch", 1))
def _(spark, root):
    """Each part of the feed is one run of the same checkpoint, so one micro-batch."""
    path, feed = scratch(spark, "late"), scratch(spark, "feed")
    arrivals = shuffled_arrivals(spark, root)
    router = late.LateRouter(spark, f"{path}/out")
    moment = F.col("ingestion_timestamp")
    for low, high in zip((None, *CUTS), (*CUTS, None)):
        part = arrivals if low is None else arrivals.filter(moment >= low)
        part = part if high is None else part.filter(moment < high)
        part.select(dump_row(part.drop("metadata")).alias("value")).write.mode("append").text(feed)
        events = sources.parse(sources.read_lines(spark, feed))
        finish(late.route_late_rows(events, router, f"{path}/checkpoint"))
    return router.rows().select("event_id", F.col("batch").cast("long").alias("batch"), "lateness")


BY_FEED = (
    "max(event_timestamp) OVER (PARTITION BY event_type ORDER BY ingestion_timestamp RANGE BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW) - INTERVAL 10 SECOND")


@query("wn14_stream_feed_clocks", with_ctes(
    "SELECT event_id, event_type, w AS watermark, CASE WHEN event_timestamp < w - INTERVAL 10 SECOND THEN 'dropped' "
    f"WHEN event_timestamp < w THEN 'allowed' ELSE 'on_time' END AS lateness FROM (SELECT *, {BY_FEED} AS w FROM {ARRIVED})", "activity_ev"))
def _(spark, root):
    """A clock per type of event, kept over three runs of a checkpoint; rows are judged at their own arrival."""
    path, feed = scratch(spark, "clocks"), scratch(spark, "feed")
    feeds = clocks.FeedClocks(spark, f"{path}/out", "event_type")
    arrivals = shuffled_arrivals(spark, root)
    moment = F.col("ingestion_timestamp")
    for low, high in zip((None, *CUTS[1::2]), (*CUTS[1::2], None)):
        part = arrivals if low is None else arrivals.filter(moment >= low)
        part = part if high is None else part.filter(moment < high)
        part.select(dump_row(part.drop("metadata")).alias("value")).write.mode("append").text(feed)
        events = sources.parse(sources.read_lines(spark, feed))
        finish(late.route_late_rows(events, feeds, f"{path}/checkpoint"))
    return feeds.rows().select("event_id", "event_type", "watermark", "lateness")


def on_one_day(df):
    """The events with the times of day they have, all on one day; each arrives as long after it as before."""
    seconds = F.unix_micros("event_timestamp") - F.unix_micros(F.date_trunc("day", "event_timestamp"))
    delay = F.unix_micros("ingestion_timestamp") - F.unix_micros("event_timestamp")
    day = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return df.withColumns({
        "event_timestamp": F.timestamp_micros(day + seconds), "ingestion_timestamp": F.timestamp_micros(day + seconds + delay)})


HOUR_OF_DAY = "lpad(CAST(hour(event_timestamp) AS VARCHAR), 2, '0')"


@query("snk25_rolled_archive", with_ctes(
    f"SELECT {HOUR_OF_DAY} AS hour, count(*) AS events, {amount('CAST(sum(coalesce(total_cents, 0)) AS BIGINT)')} AS amount, "
    "CAST(0 AS BIGINT) AS too_large, CAST(1 AS BIGINT) AS few_files, CAST(1 AS BIGINT) AS logged FROM activity_ev GROUP BY ALL", "activity_ev"))
def _(spark, root):
    """The feed on one day, in two micro-batches of the stream, with files of at most 128 KiB."""
    path, limit = scratch(spark, "rolled"), 128 * 1024
    archive = RolledArchive(spark, f"{path}/out", limit)
    feed, each = json_folder(spark, root, 2, lambda s, r: on_one_day(R.activity_events(s, r)))
    lines = sources.read_lines(spark, feed, max_files_per_trigger=each)
    finish(sinks.start_rolled(sources.parse(lines), archive, "event_timestamp", f"{path}/checkpoint", availableNow=True))
    size = (F.octet_length("value") + 1).alias("size")
    money = F.get_json_object("value", "$.total_amount").cast("decimal(14,2)")
    files = archive.read().select("*", size, money.alias("money")).groupBy("run", "batch", "hora", "file").agg(
        F.count(F.lit(1)).alias("events"), F.sum("money").alias("money"), F.sum("size").alias("bytes"))
    told = archive.log().select("run", "batch", "hora", "file", F.col("bytes").alias("told"))
    files = files.join(told, ["run", "batch", "hora", "file"], "full")
    # every file of a batch and hour but the last is nearly full
    enough = F.ceil(F.sum("bytes") / (limit * 0.75)) + F.count_distinct("run", "batch")
    return files.groupBy(F.col("hora").alias("hour")).agg(
        F.sum("events").alias("events"), F.coalesce(F.sum("money"), F.lit(0)).cast("double").alias("amount"),
        F.sum((F.col("bytes") > limit).cast("long")).alias("too_large"),
        (F.count(F.lit(1)) <= enough).cast("int").alias("few_files"),
        F.min(F.col("bytes").eqNullSafe(F.col("told")).cast("int")).alias("logged"))


def write_shouted(df, path, compression="gzip"):
    """Events as a producer sends them: upper-case types and statuses, some blank customers, no field without a value.

    The files are compressed, as plain lines are several times the tables they come from.
    """
    df = df.drop("metadata").withColumns({
        "event_type": F.upper("event_type"), "status": F.upper("status"),
        "customer_id": F.when(F.col("quantity") == 13, " ").otherwise(F.concat(F.lit(" "), "customer_id"))})
    df.select(dump_row(df, nulls=False).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def shouted_folder(spark, root, moved=lambda df: df):
    """All kinds of events as a producer sends them."""
    path = scratch(spark, "feed")
    write_shouted(moved(R.all_events(spark, root)), path)
    return path


#: Lines whose events one part of a feed holds, and the most parts; each part reads the tables once.
PART_LINES, MOST_PARTS = 3_000_000, 8


def shouted_parts(spark, root, path, compression="gzip"):
    """The feed of :func:`shouted_folder` in parts that lie in the folder one after the other; yields the folder for each.

    A stream that keeps its checkpoint takes each part before the next one replaces it, so that never more
    than a part lies on disk. Events of an order are in the same part, whose join has the lines and orders of the part alone.
    """
    lines = R.table(spark, root, "lineitem").count()
    parts = max(1, min(MOST_PARTS, -(-lines // PART_LINES)))
    for part in range(parts):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == part  # noqa: B023, E731
        of_lines = R.line_events(spark, root).filter(mine("order_id"))
        with settings(spark, FREE_SHUFFLES):
            write_shouted(of_lines.unionByName(R.activity_events(spark, root).filter(mine("event_id"))), path, compression)
        yield path


@query("st8_stream_alerts_upper", with_ctes(
    "SELECT DISTINCT alert_id, alert_type, customer_id FROM "
    + ALERTS.replace("FROM all_ev WHERE", "FROM all_ev WHERE quantity IS DISTINCT FROM 13 AND"), "all_ev"))
def _(spark, root):
    feed, path = scratch(spark, "feed"), scratch(spark, "shouted")
    table = sinks.alert_table(spark, f"{path}/alerts")
    for _ in shouted_parts(spark, root, feed, "lz4"):  # written in half the time of gzip; a part at a time lies on disk
        good, _bad = run.prepared(spark, feed, A.EVENT_RULE_FIELDS)
        finish(sinks.start_keyed(A.detect(good), table, A.serialize, f"{path}/checkpoint"))
    return table.read().select("alert_id", "alert_type", "customer_id").distinct()


@query("st8_stream_quarantine", with_ctes(
    "SELECT event_id, 'customer_id' AS missing FROM all_ev WHERE quantity = 13", "all_ev"))
def _(spark, root):
    feed, path = scratch(spark, "feed"), scratch(spark, "quarantine")
    for _ in shouted_parts(spark, root, feed):
        _good, bad = run.prepared(spark, feed)
        finish(sinks.start_parquet(bad, f"{path}/out", f"{path}/checkpoint"))
    return spark.read.schema(bad.schema).parquet(f"{path}/out").select("event_id", "missing")


USABLE = "FROM all_ev WHERE quantity IS DISTINCT FROM 13"


@query("st8_whole_job", with_ctes(
    f"SELECT 'events' AS name, event_type AS kind, count(*) AS n {USABLE} GROUP BY ALL "
    f"UNION ALL SELECT 'late' AS name, 'on_time' AS kind, count(*) AS n {USABLE} "
    "UNION ALL SELECT 'quarantine' AS name, 'customer_id' AS kind, count(*) AS n FROM all_ev WHERE quantity = 13 "
    "UNION ALL SELECT 'alerts' AS name, alert_type AS kind, count(DISTINCT (alert_id, CAST(event_timestamp AS TIME))) AS n FROM "
    + ALERTS.replace("FROM all_ev WHERE", "FROM all_ev WHERE quantity IS DISTINCT FROM 13 AND") + " GROUP BY ALL "
    "UNION ALL SELECT 'metrics' AS name, 'queries that received every line' AS kind, CAST(6 AS BIGINT) AS n", "all_ev"))
def _(spark, root):
    """The job as it is started, over all kinds of events on one busy day: what each of its tables holds."""
    feed, out = shouted_folder(spark, root, on_one_day), scratch(spark, "job")
    run.run_available(spark, feed, out, f"{out}/checkpoint")
    table = lambda name: sinks.alert_table(spark, f"{out}/{name}").read()
    count = F.count(F.lit(1)).alias("n")
    per = lambda df, name, kind: df.groupBy(kind.alias("kind")).agg(count).select(F.lit(name).alias("name"), "kind", "n")
    archived = spark.read.text(f"{out}/events").select(F.get_json_object("value", "$.event_type").alias("t"))
    lines = spark.read.text(feed).count()
    told = spark.read.parquet(f"{out}/metrics").filter("name = 'streaming_events_received'")
    full = told.groupBy(F.col("tags")["query"].alias("q")).agg(F.sum("value").alias("v")).filter(F.col("v") >= lines)
    frames = [
        per(archived, "events", F.col("t")),
        per(spark.read.parquet(f"{out}/late/rows"), "late", F.col("lateness")),
        per(spark.read.parquet(f"{out}/quarantine"), "quarantine", F.concat_ws(",", "missing")),
        per(table("alerts"), "alerts", F.col("alert_type")),
        per(full, "metrics", F.lit("queries that received every line")),
    ]
    return reduce(DataFrame.unionByName, frames)


def repeating_folder(spark, root):
    """The activity feed in five parts in event order. Each part delivers its events twice and, once more, those
    of the last hours of the part before it: repeats inside a micro-batch, across micro-batches, and behind the watermark.

    A part has as many compressed files as its rows ask for. Returns the folder and the number of files of a part.
    """
    path, events = scratch(spark, "feed"), R.activity_events(spark, root).drop("metadata")
    each = files_for(spark, root, (len(CUTS) + 1) / 2)
    moment = F.col("event_timestamp")
    for low, high in zip((None, *CUTS), (*CUTS, None)):
        part = events if low is None else events.filter(moment >= low)
        part = part if high is None else part.filter(moment < high)
        fed = part.unionByName(part)
        if low is not None:
            recent = F.lit(low).cast("timestamp") - F.expr("INTERVAL 6 HOURS")
            fed = fed.unionByName(events.filter((moment >= recent) & (moment < low)))
        lines = fed.select(dump_row(fed).alias("value"))
        lines = lines.coalesce(1) if each == 1 else lines.repartition(each)
        lines.write.mode("append").option("compression", "gzip").text(path)
    return path, each


@query("ded5_stream_repeats", SLIDING.replace(
    "SELECT * EXCLUDE (kind, types), kind AS event_type FROM", "SELECT window_start, window_end, key AS customer_id, event_count, "
    "unique_customers, total_quantity, total_amount, types AS event_types FROM") + f" WHERE {CLOSED}")
def _(spark, root):
    feed, each = repeating_folder(spark, root)
    lines = sources.read_lines(spark, feed, max_files_per_trigger=each)
    return to_parquet(spark, job.customer_windows(sources.parse(lines), job.JOB), "repeats")
