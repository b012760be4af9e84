"""Steps whose work per task, or per row, must not grow with the tables."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tallyhouse import session
from tallyhouse.functions import rules
from tallyhouse.operators import alerts as A
from tallyhouse.operators import curate, deliveries
from tallyhouse.operators.skew import HeavyKeys
from tallyhouse.plans import batch, copartition, incremental
from tallyhouse.queries import QUERIES, alerting, loads, quality, scans, streams
from tallyhouse.session import scratch
from tallyhouse.sinks import files, published
from tallyhouse.sinks.keyed import KeyedTable
from tallyhouse.sinks.published import Published
from tallyhouse.sources import relational as R
from tallyhouse.streaming import run, sinks

COALESCED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_larger_inputs_start_from_more_shuffle_partitions(spark, root, monkeypatch):
    QUERIES["prj2_typed_branches"](spark, root)
    assert int(spark.conf.get(COALESCED)) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "SHUFFLE_BYTES", 1024)
    branches = QUERIES["prj2_typed_branches"](spark, root)
    assert int(spark.conf.get(COALESCED)) > 100 and branches.count() == 4
    session.size_shuffles(spark, f"{root}/no_such_folder")
    assert int(spark.conf.get(COALESCED)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_a_write_by_event_type_moves_and_sorts_no_rows(spark, root):
    events = R.activity_events(spark, root)
    assert files.gather_by_partition(events, ["event_type"]) is events
    assert "rebalance" in plan(files.gather_by_partition(events, ["event_type", "customer_id"])).lower()
    path = scratch(spark, "types")
    files.write_clean(events, path, ["event_type"])
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    back = spark.read.parquet(path).select(*events.columns)
    assert back.drop("metadata").exceptAll(events.drop("metadata")).isEmpty() and back.count() == events.count()


def test_features_get_their_columns_after_their_rows_have_moved(spark, root, monkeypatch):
    seen = []
    monkeypatch.setattr(files, "gather_by_partition", lambda df, c, real=files.gather_by_partition: seen.append((df, c)) or real(df, c))
    curated, out = scratch(spark, "curated"), scratch(spark, "features")
    files.write_curated(curate.curate(R.order_events(spark, root)), curated)
    seen.clear()
    stored = batch.curated_to_features(spark, curated, out)
    (rows, columns), = seen
    assert list(columns) == ["event_year", "event_month"] and "high_value_order" not in rows.columns
    assert stored.count() == rows.count() and "quantity_log" in stored.columns


def test_valid_and_quarantined_rows_are_counted_in_one_pass(spark, root):
    spoiled = quality.spoiled(spark, root)
    valid, bad = rules.split(rules.judge(spoiled))
    counted = rules.split_counts(spoiled, "event_type")
    told = {(r["event_type"], r["valid"]): r["n"] for r in counted.collect()}
    for side, frame in ((True, valid), (False, bad)):
        assert {k[0]: n for k, n in told.items() if k[1] is side} == Counter(r[0] for r in frame.select("event_type").collect())
    assert plan(QUERIES["qc3_valid_and_quarantined"](spark, root)).count("lineitem.parquet") <= 1
    assert plan(QUERIES["qc3_valid_and_quarantined"](spark, root)).count("Join") == 1


def test_alerts_and_failures_come_from_one_pass(spark, root):
    events, wanted = R.all_events(spark, root), alerting.fragile_rules()
    out = A.outcomes(events, wanted, "event_id")
    alerts = out.filter("error is null").select("alert_id", "alert_type")
    failed = out.filter("error is not null").select("event_id", "alert_type", "error")
    for mine, other in ((alerts, A.detect(events, wanted).select("alert_id", "alert_type")), (failed, A.failures(events, wanted, "event_id"))):
        assert mine.exceptAll(other).isEmpty() and mine.count() == other.count() > 0
    assert plan(QUERIES["al5_failing_rules"](spark, root)).count("Join") == 1


def test_buckets_grow_with_the_rows(spark, root, monkeypatch):
    assert copartition.buckets_for(0) == 8 and copartition.buckets_for(10 * copartition.BUCKET_ROWS + 1) == 11
    lines = R.table(spark, root, "lineitem").count()
    monkeypatch.setattr(copartition, "BUCKET_ROWS", lines // 20)
    made, real = [], copartition.store
    monkeypatch.setattr(copartition, "store", lambda df, layout, *a, **k: made.append(layout.buckets) or real(df, layout, *a, **k))
    joined = loads.sales_and_deliveries(spark, root)
    assert min(made) >= 20 and joined.count() > lines


def test_the_stage_of_a_summary_is_no_key_of_its_groups(spark, root):
    summary = deliveries.create_summary(R.delivery_events(spark, root))
    assert summary.columns[:4] == ["carrier", "status", "delivery_stage", "delivery_delay_category"]
    grouping = [line for line in plan(summary).splitlines() if "Aggregate [" in line][0]
    assert "delivery_stage" not in grouping.split("]")[0]


def test_repeating_feed_is_dealt_over_files_of_few_rows(spark, root, monkeypatch):
    monkeypatch.setattr(scans, "FILE_ROWS", R.activity_events(spark, root).count() // 10)
    feed, each = streams.repeating_folder(spark, root)
    lines = spark.read.text(feed)
    sizes = [r["n"] for r in lines.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert each >= 4 and len(sizes) == 5 * each and max(sizes) < sum(sizes) / 8


def test_the_dedupe_of_a_larger_input_has_more_and_smaller_sorts(spark, root, monkeypatch):
    monkeypatch.setattr(session, "SHUFFLE_BYTES", 8192)
    monkeypatch.setattr(session, "TASK_BYTES", 16384)
    records = QUERIES["rdd5_distinct_records"](spark, root)
    assert records.count() == R.all_events(spark, root).select("event_id").distinct().count()
    assert int(spark.conf.get(COALESCED)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("16384", "16384b")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_a_feed_in_parts_lies_on_disk_part_by_part(spark, root, monkeypatch):
    lines = R.table(spark, root, "lineitem").count()
    monkeypatch.setattr(streams, "PART_LINES", lines // 3)
    ids, seen = lambda df: Counter(r[0] for r in df.select("event_id").collect()), []
    for feed in streams.shouted_parts(spark, root, scratch(spark, "feed")):
        text = spark.read.text(feed).select(F.get_json_object("value", "$.event_id").alias("event_id"))
        seen.append(ids(text))
    assert len(seen) >= 3 and sum(seen, Counter()) == ids(R.all_events(spark, root))
    assert max(sum(s.values()) for s in seen) < 0.5 * sum(sum(s.values()) for s in seen)
    rows = QUERIES["st8_stream_quarantine"](spark, root)
    assert ids(rows) == ids(R.order_events(spark, root).filter("quantity = 13"))
    table = QUERIES["st8_stream_alerts_upper"](spark, root)
    events = R.all_events(spark, root).filter("quantity is null or quantity <> 13")
    assert table.count() == A.detect(events).select("alert_id", "alert_type", "customer_id").distinct().count()


def test_a_load_of_a_mart_joins_nothing_again_and_moves_no_row(spark, root, monkeypatch):
    staged, real = [], Published.stage
    monkeypatch.setattr(Published, "stage", lambda self, table, rows, *a: staged.append((table, rows)) or real(self, table, rows, *a))
    mart = loads.loaded_mart(spark, root)
    assert {table for table, _ in staged} == {"product_sales_rows", "product_sales_changes"} and len(staged) == 8
    for _, rows in staged:
        executed = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in executed and "Join" not in executed
    gathered = []
    monkeypatch.setattr(published, "gather_by_partition", lambda df, by: gathered.append(by) or df)
    mart.apply(loads.orders(spark, root).select(*loads.SOLD).limit(3))
    assert gathered == [["month"]]  # other loads still bring the rows of a partition together


def test_a_mart_by_partition_moves_each_row_once(spark, root, monkeypatch):
    mart, exchange = loads.loaded_mart(spark, root), "Exchange hashpartitioning"
    sales, exchanges = loads.orders(spark, root), lambda df: df._jdf.queryExecution().executedPlan().toString().count(exchange)
    sums = [F.count(F.lit(1)).alias("row_count"), F.sum("quantity").alias("total_quantity"), (F.sum("total_amount") * 100).cast("long").alias("total_revenue")]
    counts = [F.count_distinct("order_id").alias("unique_orders"), F.count_distinct("customer_id").alias("unique_customers")]
    wanted = Counter(map(tuple, sales.groupBy("month", "product_id", "status").agg(*sums, *counts).collect()))
    told = lambda df: Counter(map(tuple, df.collect()))
    once = mart.read_by_partition()
    assert exchanges(once) == 1 and told(once) == wanted
    monkeypatch.setattr(incremental, "find_heavy_keys", lambda df, key: HeavyKeys(tuple(r[0] for r in df.distinct().limit(500).collect()), False))
    some = mart.read_by_partition()
    assert exchanges(some) == 3 and told(some) == wanted  # one for the others, two for the heavy keys
    monkeypatch.setattr(incremental, "COMBINED", 0)
    combined = mart.read_by_partition()
    assert exchanges(combined) == 2 and told(combined) == wanted


def test_windows_are_stored_by_key_without_being_ranked(spark, root, monkeypatch):
    plans, real = [], KeyedTable._write
    monkeypatch.setattr(KeyedTable, "_write", lambda self, rows, *a: plans.append(plan(rows)) or real(self, rows, *a))
    stored = QUERIES["snk14_stream_keyed_windows"](spark, root)
    assert plans and not any("row_number" in p for p in plans)
    assert stored.count() == stored.select("row_key").distinct().count() > 0


def test_the_whole_job_parses_a_feed_once_and_keeps_one_version_of_its_state(spark, root, monkeypatch):
    feed, out, kept = scratch(spark, "feed"), scratch(spark, "job"), "spark.sql.streaming.maxBatchesToRetainInMemory"
    streams.write_shouted(R.activity_events(spark, root), feed)
    spark.range(1).selectExpr("'no event' AS value").write.mode("append").text(feed)
    before, told, running = spark.conf.get(kept), [], []
    monkeypatch.setattr(run, "read_lines", lambda *a, real=run.read_lines, **k: told.append("parsed") or real(*a, **k))

    def start_keyed(*a, real=sinks.start_keyed, **k):
        told.append(spark.conf.get(kept))
        running.append([q.lastProgress is None or q.isActive for q in spark.streams.active if q.id == windows[0].id])
        return real(*a, **k)

    windows, real = [], sinks.start_both
    monkeypatch.setattr(sinks, "start_both", lambda *a, **k: windows.append(real(*a, **k)) or windows[0])
    monkeypatch.setattr(sinks, "start_keyed", start_keyed)
    run.run_available(spark, feed, out, f"{out}/checkpoint")
    assert told == ["parsed", "1", "1"] and spark.conf.get(kept) == before
    assert running[-1] == []  # the windows have ended where their alerts begin
    landed = spark.read.parquet(f"{out}/landed")
    assert landed.count() == spark.read.text(feed).count()
    assert {r["line"] for r in landed.filter("event_id is null").collect()} == {"no event"}
    assert landed.filter("line is not null").count() == spark.read.parquet(f"{out}/quarantine").count() >= 1
    assert spark.read.text(f"{out}/events").count() == landed.filter("line is null").count()


def test_keyed_windows_are_closed_part_by_part(spark, root, monkeypatch):
    wanted = QUERIES["snk14_stream_keyed_windows"](spark, root).collect()
    rows, batches, real = R.table(spark, root, "events").count(), [], KeyedTable._write
    monkeypatch.setattr(streams, "PART_EVENTS", rows // 3)
    monkeypatch.setattr(KeyedTable, "_write", lambda self, df, *a: real(self, df, *a) or batches.append(a[0]))
    found = QUERIES["snk14_stream_keyed_windows"](spark, root)
    assert len(batches) >= 6 and "Window" not in plan(found)
    assert Counter(map(str, found.collect())) == Counter(map(str, wanted)) and wanted
    sizes = [df.isStreaming and spark.read.parquet(feed).count() for feed in [scratch(spark, "feed")] for df in streams.timed_parts(spark, root, feed)]
    assert len(sizes) >= 3 and sum(sizes) == rows and max(sizes) < 0.5 * rows


def test_features_of_a_larger_layer_are_built_by_parts_of_months(spark, root, monkeypatch):
    seen, free, clean = [], [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    curated, out = scratch(spark, "curated"), scratch(spark, "features")
    files.write_curated(curate.curate(R.all_events(spark, root)).withColumn(
        "event_timestamp", F.when(F.col("quantity") == 13, None).otherwise(F.col("event_timestamp"))), curated)
    whole = {(r[0], r[1]): r[2] for r in batch.curated_to_features(spark, curated, out).groupBy("event_year", "event_month").count().collect()}
    monkeypatch.setattr(batch, "PART_BYTES", session.stored_bytes(spark, curated) // 3)
    gather = files.gather_by_partition
    monkeypatch.setattr(files, "gather_by_partition", lambda df, c: seen.append(df) or free.append(spark.conf.get(clean)) or gather(df, c))
    stored = batch.curated_to_features(spark, curated, out).groupBy("event_year", "event_month").count().collect()
    assert {(r[0], r[1]): r[2] for r in stored} == whole and (None, None) in whole
    assert len(seen) >= 3 and set(free) == {"true"} and spark.conf.get(clean) != "true"
    months = [{tuple(r) for r in df.select("event_year", "event_month").distinct().collect()} for df in seen]
    assert sum(map(len, months)) == len(set.union(*months)) == len(whole)


def test_alerts_are_found_from_the_fields_of_their_rules(spark, root, monkeypatch):
    feed, asked = scratch(spark, "feed"), []
    streams.write_shouted(R.all_events(spark, root), feed, "lz4")
    lines = spark.read.text(feed)
    from_lines = lambda *fields: A.serialize(A.detect(run.split(run.parse_kept(lines, *fields))[0])).drop("detected_at")
    few, whole = from_lines(A.EVENT_RULE_FIELDS), from_lines()
    assert few.exceptAll(whole).isEmpty() and few.count() == whole.count() > 0
    monkeypatch.setattr(run, "parse_kept", lambda df, fields, real=run.parse_kept: asked.append(set(fields)) or real(df, fields))
    QUERIES["st8_stream_alerts_upper"](spark, root)
    assert asked == [set(A.EVENT_RULE_FIELDS)]
