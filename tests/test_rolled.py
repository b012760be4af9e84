"""Files of bounded size and clocks of feeds."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyhouse.schemas import struct
from tallyhouse.session import scratch
from tallyhouse.sinks.rolled import RolledArchive
from tallyhouse.streaming import clocks, late

LINES = struct("value STRING, ano STRING, mes STRING, dia STRING, hora STRING")


def lines(spark, values, hora="05"):
    return spark.createDataFrame([(v, "2024", "01", "02", hora) for v in values], LINES).repartition(3)


def read_back(archive):
    return Counter(r["value"] for r in archive.read().collect())


def test_files_stay_below_the_limit_and_nothing_is_lost(spark):
    values = [f"line {k} " + "x" * (k % 50) for k in range(2000)] + [""] * 5 + ["é" * 20] * 3
    archive = RolledArchive(spark, scratch(spark, "rolled"), limit_bytes=4096)
    archive.write(lines(spark, values), 0)
    assert read_back(archive) == Counter(values)
    sizes = [r["bytes"] for r in archive.log().collect()]
    total = sum(len(v.encode()) + 1 for v in values)
    assert sum(sizes) == total and max(sizes) <= 4096 and len(sizes) <= total // 3500 + 2
    held = archive.read().groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("b"))
    assert {r["file"]: r["b"] for r in held.collect()} == {r["file"]: r["bytes"] for r in archive.log().collect()}


@pytest.mark.parametrize("cells", [1, 4096])
def test_a_line_that_repeats_often_is_spread(spark, cells):
    values = ["hot line"] * 1500 + [f"cold {k}" for k in range(300)] + ["long " * 300] * 4
    archive = RolledArchive(spark, scratch(spark, "rolled"), limit_bytes=1000, cells=cells)
    archive.write(lines(spark, values), 0)
    assert read_back(archive) == Counter(values)
    rows = archive.log().collect()
    assert sum(r["lines"] for r in rows) == len(values)
    # lines longer than the limit have files of their own
    assert all(r["bytes"] <= 1000 or r["lines"] == 1 for r in rows)


def test_a_replayed_batch_makes_the_same_files(spark):
    values = [f"line {k}" for k in range(500)] + ["again"] * 200
    archive = RolledArchive(spark, scratch(spark, "rolled"), limit_bytes=1000)
    archive.write(lines(spark, values), 3)
    first = sorted(map(tuple, archive.read().select("hora", "file", "value").collect()))
    archive.write(lines(spark, list(reversed(values))).repartition(5), 3)
    assert sorted(map(tuple, archive.read().select("hora", "file", "value").collect())) == first


def test_lines_without_time_null_lines_and_nothing(spark):
    archive = RolledArchive(spark, scratch(spark, "rolled"))
    rows = spark.createDataFrame([("a", None, None, None, None), (None, "2024", "01", "01", "00")], LINES)
    archive.write(rows, 0)
    archive.write(rows.limit(0), 1)
    assert read_back(archive) == {"a": 1} and archive.log().count() == 1
    with pytest.raises(ValueError):
        RolledArchive(spark, "x", limit_bytes=1)


def test_batches_without_log_are_not_read(spark):
    archive = RolledArchive(spark, scratch(spark, "rolled"))
    archive.write(lines(spark, ["kept"]), 0)
    half = lines(spark, ["half written"]).withColumn("file", F.lit("000000"))
    half.write.partitionBy("ano", "mes", "dia", "hora", "file").text(f"{archive.path}/rows/run=batch/batch=1")
    assert read_back(archive) == {"kept": 1}


EVENTS = struct("event_id STRING, feed STRING, event_timestamp TIMESTAMP, ingestion_timestamp TIMESTAMP, quantity INT")


def test_feeds_have_clocks_of_their_own(spark):
    path = scratch(spark, "clocks")
    feeds = clocks.FeedClocks(spark, f"{path}/out", "feed")

    def at(second):
        return None if second is None else f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}"

    batches = [
        # (id, feed, event second, arrival second): c is late by the clock of its feed, d is not; e and f have no time
        [("a", "x", 100, 100), ("b", "y", 10, 101), ("c", "x", 85, 102), ("d", "y", 5, 103), ("e", "x", None, 104), ("f", None, 1, None)],
        [("g", "x", 79, 105), ("h", "y", 300, 105), ("i", "y", 285, 105), ("j", None, 0, 106)],
    ]
    for rows in batches:
        data = [(i, feed, at(e), at(s), None if i in "ae" else 3) for i, feed, e, s in rows]
        df = spark.createDataFrame(data, "event_id STRING, feed STRING, e STRING, a STRING, quantity INT")
        df = df.select("event_id", "feed", F.to_timestamp("e").alias("event_timestamp"), F.to_timestamp("a").alias("ingestion_timestamp"), "quantity")
        df.coalesce(1).write.mode("append").parquet(f"{path}/feed")
        stream = spark.readStream.schema(EVENTS).parquet(f"{path}/feed")
        query = late.route_late_rows(stream, feeds, f"{path}/cp")
        query.awaitTermination()
        assert query.exception() is None
    out = feeds.rows()
    assert {r["event_id"]: r["lateness"] for r in out.collect()} == {
        "a": "on_time", "b": "on_time", "c": "allowed", "d": "on_time", "e": "on_time", "f": "on_time",
        "g": "dropped", "h": "on_time", "i": "allowed", "j": "on_time"}
    assert {r["event_id"]: r["quantity"] for r in out.collect()}["a"] is None
    # a replayed batch replaces itself
    last = out.filter("batch = 1").drop("watermark", "lateness", "run", "batch")
    saved = spark.createDataFrame(last.collect(), last.schema)
    for batch in (0, 0):
        feeds(saved, batch)
    assert feeds.rows().filter("run = 'batch'").count() == last.count()
    feeds(saved.limit(0), 1)
    clock = spark.read.parquet(f"{feeds.path}/clocks/run=batch")
    assert clock.filter("batch = 0").drop("batch").exceptAll(clock.filter("batch = 1").drop("batch")).isEmpty()
    lowest = clocks.lowest_watermark(out.filter("feed IS NOT NULL"), "feed").select(F.unix_timestamp("watermark").alias("w")).first().w
    assert lowest == out.filter("event_id = 'a'").select(F.unix_timestamp("event_timestamp").alias("t")).first().t - 10


def test_an_hour_of_many_files_has_cells_that_are_small_against_the_limit(spark):
    values = [f"{i:06d}" + "x" * 94 for i in range(40_000)]
    archive = RolledArchive(spark, scratch(spark, "rolled"), limit_bytes=16 * 1024, cells=512)
    archive.write(lines(spark, values), 0)
    assert read_back(archive) == Counter(values)
    sizes = [r["bytes"] for r in archive.log().collect()]
    assert max(sizes) <= 16 * 1024
    # files are filled to three quarters at least
    assert len(sizes) <= sum(sizes) / (0.75 * 16 * 1024) + 1
