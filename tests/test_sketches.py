"""Stored sketches: merges, error bounds beyond their size, empty and null input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import sketches as K


def sample_frame(spark, rows):
    """Latencies of three days with a long tail, values repeated."""
    return spark.range(rows).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("name"),
        (F.pmod(F.col("id") * 7919, F.lit(10_007)).cast("double") ** 2 / 100).alias("value"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 3).cast("int"))).alias("timestamp"))


def test_ranks_of_merged_days_stay_within_the_error(spark):
    samples = sample_frame(spark, 60_000)
    days = K.daily_latencies(samples)
    assert days.count() == 6
    report = K.latency_report(K.merged_latencies(days))
    for row in K.rank_errors(report, samples, []).collect():
        assert max(row[f"{p}_error"] for p in K.POINTS) <= 2 * K.RANK_ERROR
    exact = {r["name"]: r for r in samples.groupBy("name").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top")).collect()}
    for row in report.collect():
        want = exact[row["name"]]
        assert (row["samples"], row["max_ms"]) == (want["n"], want["top"])
        assert abs(row["mean_ms"] - want["mean"]) < 1e-6


def test_rank_errors_find_a_wrong_value(spark):
    samples = sample_frame(spark, 3_000)
    wrong = K.latency_report(K.merged_latencies(K.daily_latencies(samples))).withColumn("p50", F.col("p95"))
    assert all(r["p50_error"] > 0.3 for r in K.rank_errors(wrong, samples, []).collect())


def test_few_samples_are_exact_and_bad_ones_left_out(spark):
    rows = [("a", 5.0, None), ("a", 1.0, None), ("a", 9.0, None), ("a", -4.0, None), ("a", None, None), (None, 2.0, None)]
    samples = spark.createDataFrame(rows, "name STRING, value DOUBLE, timestamp TIMESTAMP")
    found = {r["name"]: r for r in K.latency_report(K.merged_latencies(K.daily_latencies(samples))).collect()}
    assert (found["a"]["samples"], found["a"]["p50"], found["a"]["p99"]) == (3, 5.0, 9.0)
    assert found[None]["p50"] == 2.0
    shares = K.share_within(K.merged_latencies(K.daily_latencies(samples)), 5.0)
    assert {r["name"]: round(r["share_within"], 6) for r in shares.collect()}["a"] == round(2 / 3, 6)
    assert K.latency_report(K.merged_latencies(K.daily_latencies(samples.limit(0)))).count() == 0


def test_sets_unite_without_counting_a_customer_twice(spark):
    events = spark.range(120_000).select(
        (F.col("id") % 3).alias("day"), F.pmod(F.col("id") * 31, F.lit(30_000)).cast("string").alias("customer_id"))
    stored = K.customer_sets(events, "day")
    (row,) = K.set_sizes(K.united_sets(stored)).collect()
    assert row["event_count"] == 120_000
    assert abs(row["unique_customers"] - 30_000) <= K.SET_ERROR * 30_000
    few = K.set_sizes(K.united_sets(K.customer_sets(events.filter("cast(customer_id AS INT) < 4000"), "day")))
    assert few.first()["unique_customers"] == 4000


def test_sets_of_nulls_and_overlaps(spark):
    rows = [("x", "1"), ("x", "2"), ("x", None), ("y", None)]
    left = K.customer_sets(spark.createDataFrame(rows, "kind STRING, customer_id STRING"), "kind")
    assert {r["kind"]: r["unique_customers"] for r in K.set_sizes(left).collect()} == {"x": 2, "y": 0}
    right = K.customer_sets(spark.createDataFrame([("x", "2"), ("x", "3")], "kind STRING, customer_id STRING"), "kind")
    both = {r["kind"]: (r["in_both"], r["in_left_only"]) for r in K.overlap(left, right, ["kind"]).collect()}
    assert both == {"x": (1, 1), "y": (0, 0)}


def test_sketched_stream_holds_no_row_per_customer(spark, tmp_path):
    """The exact form keeps a row per customer and pane in state, the sketched one a row per pane."""
    from tallyhouse.streaming import job, sources

    path, schema = str(tmp_path / "feed"), "event_id STRING, event_type STRING, event_timestamp TIMESTAMP, customer_id STRING, quantity INT, total_amount DECIMAL(14,2)"
    spark.range(2_000).select(
        F.col("id").cast("string").alias("event_id"), F.lit("order").alias("event_type"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 20).alias("event_timestamp"),
        (F.col("id") % 500).cast("string").alias("customer_id"), F.lit(1).alias("quantity"),
        F.lit(2).cast("decimal(14,2)").alias("total_amount")).coalesce(1).write.parquet(path)
    held = {}
    for name, build in (("exact", job.overall_windows), ("sketched", job.sketched_windows)):
        events = sources.read_stream(spark, path, "parquet", spark.createDataFrame([], schema).schema)
        running = build(events).writeStream.format("noop").option("checkpointLocation", str(tmp_path / name)).start()
        running.processAllAvailable()
        held[name] = max(op["numRowsTotal"] for report in running.recentProgress for op in report["stateOperators"])
        running.stop()
    assert held["sketched"] < 20 and held["exact"] >= 500
