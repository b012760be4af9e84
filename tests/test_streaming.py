"""Streams replayed from files: equal to batch, late rows, restarts, the whole job."""

from __future__ import annotations

import datetime as dt
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.jsontext import dump_row
from tallyhouse.operators import windows as W
from tallyhouse.operators.metrics import ProgressCounters, increment
from tallyhouse.queries.activity import shuffled_arrivals
from tallyhouse.schemas import struct
from tallyhouse.session import scratch
from tallyhouse.sinks.keyed import KeyedTable
from tallyhouse.sources import relational as R
from tallyhouse.streaming import job, late, run, sinks, sources

NOW = {"availableNow": True}


def write_feed(df, path, files):
    """JSON lines in arrival order, one file after the other: a file stream goes by file time."""
    moment = F.unix_micros("ingestion_timestamp")
    shares = [i / files for i in range(1, files)]
    cuts = df.select(moment.alias("m")).approxQuantile("m", shares, 0.001) if shares else []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df if low is None else df.filter(moment >= low)
        part = part if high is None else part.filter(moment < high)
        lines = part.coalesce(1).select(dump_row(df.drop("metadata")).alias("value"))
        lines.write.mode("append").text(path)


@pytest.fixture(scope="module")
def late_feed(spark, root):
    """Five files in order of arrival, then the first day's rows once more, weeks late."""
    path = scratch(spark, "feed")
    events = shuffled_arrivals(spark, root)
    write_feed(events, path, 5)
    write_feed(first_day(events), path, 1)
    return path


def first_day(events):
    return events.filter(F.col("event_timestamp") < "2024-01-02")


def finish(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_stream_windows_equal_batch(spark, root):
    """In-order feed: every closed window of the stream is the batch window."""
    feed, out = scratch(spark, "feed"), scratch(spark, "windows")
    events = R.activity_events(spark, root)
    write_feed(events, feed, 4)
    stream = sources.parse(sources.read_lines(spark, feed, max_files_per_trigger=1))
    finish(sinks.start_parquet(job.overall_windows(stream), f"{out}/out", f"{out}/cp", **NOW))
    columns = ["window_start", "event_count", "unique_customers", "total_quantity", "total_amount"]
    got = {tuple(r) for r in spark.read.parquet(f"{out}/out").select(*columns).collect()}
    end = events.agg((F.max("event_timestamp") - F.expr("INTERVAL 10 SECONDS")).alias("e")).first().e
    batch = W.process(events, ordered=False).filter(F.col("window_end") <= F.lit(end))
    want = {tuple(r) for r in batch.select(*columns).collect()}
    # rows of one file may arrive after the watermark of the file before only within ten seconds
    assert got == want


def test_late_rows_are_kept_and_labelled(spark, root, late_feed):
    path = scratch(spark, "late")
    router = late.LateRouter(spark, f"{path}/out")
    stream = sources.parse(sources.read_lines(spark, late_feed, max_files_per_trigger=1))
    finish(late.route_late_rows(stream, router, f"{path}/cp"))
    counts = {r.lateness: r["count"] for r in router.rows().groupBy("lateness").count().collect()}
    events = R.activity_events(spark, root)
    assert sum(counts.values()) == events.count() + first_day(events).count()
    assert counts["on_time"] > 0 and counts["dropped"] >= first_day(events).count()
    # a replayed batch writes the same rows again, not more
    first = router.rows().filter("batch = 1").drop("run", "batch", "lateness", "watermark")
    saved = spark.createDataFrame(first.collect(), first.schema)
    router(saved, 1)
    again = {r.lateness: r["count"] for r in router.rows().groupBy("lateness").count().collect()}
    assert again == counts


def test_spark_reports_rows_behind_the_watermark(spark, late_feed):
    path = scratch(spark, "dropped")
    counters = ProgressCounters()
    spark.streams.addListener(counters)
    stream = sources.parse(sources.read_lines(spark, late_feed, max_files_per_trigger=1))
    query = finish(sinks.start_parquet(job.customer_windows(stream), f"{path}/out", f"{path}/cp", **NOW))
    deadline = time.time() + 30
    while not counters.ended(query.id) and time.time() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(counters)
    totals = counters.totals(query.id)
    assert totals["streaming_events_received"] == spark.read.text(late_feed).count()
    assert totals["streaming_events_late"] > 0
    rows = counters.take(spark, dt.datetime(2024, 1, 1)).unionByName(counters.take(spark, dt.datetime(2024, 1, 2)))
    stored = {r["name"]: r["value"] for r in increment(rows).collect()}
    assert stored == {k: v for k, v in totals.items()}


def test_counters_outlast_the_kept_reports():
    report = SimpleNamespace(
        id="q", numInputRows=2, sink=SimpleNamespace(numOutputRows=1),
        stateOperators=[SimpleNamespace(numRowsDroppedByWatermark=3)])
    counters = ProgressCounters()
    for _ in range(1000):
        counters.onQueryProgress(SimpleNamespace(progress=report))
    assert counters.totals() == {
        "streaming_events_received": 2000, "streaming_windows_processed": 1000, "streaming_events_late": 3000}


def test_new_checkpoint_keeps_old_rows(spark):
    """The run is the checkpoint: a second one counts from 0 again and replaces nothing."""
    path = scratch(spark, "runs")
    schema = struct("row_key STRING, event_timestamp STRING")
    table = KeyedTable(spark, f"{path}/table", schema)
    for run, key in (("cp1", "k1"), ("cp2", "k2")):
        spark.createDataFrame([(key, "t1"), (key, "t2"), ("both", run)], schema).coalesce(1).write.parquet(f"{path}/{run}")
        frame = spark.readStream.schema(schema).parquet(f"{path}/{run}")
        finish(sinks.start_keyed(frame, table, lambda df: df, f"{path}/{run}-checkpoint"))
    want = {("k1", "t2"), ("k2", "t2"), ("both", "cp2")}
    assert {tuple(r) for r in table.read().collect()} == want
    assert len(table.versions()) == 2
    table.compact(5, "later")
    assert {tuple(r) for r in table.read().collect()} == want
    table.upsert(spark.createDataFrame([("k1", "t9")], schema), 6, run="later")
    assert table.get("k1").first()["event_timestamp"] == "t9" and table.log().count() == 4


def test_upper_case_feed_raises_alerts_and_keeps_bad_lines(spark):
    feed, out = scratch(spark, "feed"), scratch(spark, "job")
    order = (
        '{"event_id":"%s","event_type":"ORDER","event_timestamp":"2024-01-01T00:00:0%dZ",'
        '"ingestion_timestamp":"2024-01-01T00:00:10Z","customer_id":" c1 ","order_id":"o1","product_id":"p1",'
        '"quantity":1,"total_amount":99999.00,"status":"CREATED"}'
    )
    lines = [order % ("a", 1), order % ("b", 2), "not json", order.replace('" c1 "', '"  "') % ("c", 3)]
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.text(feed)
    for query in run.start(spark, feed, out, f"{out}/checkpoint", **NOW):
        finish(query)
    alerts = sinks.alert_table(spark, f"{out}/alerts").read()
    assert alerts.filter("customer_id = 'c1'").count() >= 2
    bad = {r["line"]: r["missing"] for r in spark.read.parquet(f"{out}/quarantine").collect()}
    assert set(bad) == {lines[2], lines[3]} and bad[lines[3]] == ["customer_id"]
    assert spark.read.parquet(f"{out}/late/rows").count() == 2


def test_lateness_allowance_adds_to_the_watermark():
    config = job.StreamConfig(allowed_lateness_seconds=20)
    assert config.watermark == "30 seconds"


def test_whole_job_runs_and_resumes(spark, root):
    feed, out = scratch(spark, "feed"), scratch(spark, "job")
    write_feed(R.activity_events(spark, root), feed, 2)
    for _ in range(2):  # the second start finds nothing new and repeats nothing
        for query in run.start(spark, feed, out, f"{out}/checkpoint", **NOW):
            finish(query)
    table = sinks.alert_table(spark, f"{out}/windows")
    rows = table.read()
    assert rows.count() == rows.select("row_key").distinct().count() > 0
    archived = spark.read.text(f"{out}/events").count()
    assert archived == R.activity_events(spark, root).count()
