"""Feeds and archives of the stream queries: whole, and much smaller on disk than their plain lines."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from compare import compare, connect
from tallyhouse.queries import ORACLES, QUERIES, scans, streams
from tallyhouse.session import scratch as real
from tallyhouse.sources import relational as R
from tallyhouse.streaming import sinks


def on_disk(path, name="part-*"):
    return sum(f.stat().st_size for f in Path(path).rglob(name))


def plain_bytes(lines):
    return lines.agg(F.sum(F.octet_length("value") + 1)).first()[0]


def test_the_feed_of_all_kinds_is_whole_and_compressed(spark, root):
    path = streams.shouted_folder(spark, root)
    lines = spark.read.text(path)
    assert lines.count() == R.all_events(spark, root).count()
    assert on_disk(path) < plain_bytes(lines) / 4


def test_quarantine_leaves_less_on_disk_than_its_lines(spark, root, monkeypatch):
    used = []
    monkeypatch.setattr(streams, "scratch", lambda s, name: used.append(real(s, name)) or used[-1])
    rows = QUERIES["st8_stream_quarantine"](spark, root).count()
    assert rows == R.all_events(spark, root).filter("quantity = 13").count()
    assert sum(map(on_disk, used)) < plain_bytes(spark.read.text(used[0])) / 4


def test_stream_archive_is_whole_and_compressed(spark, root):
    path = real(spark, "archive")
    events = R.activity_stream(spark, root)
    streams.finish(sinks.start_archive(events, f"{path}/out", "event_timestamp", f"{path}/checkpoint", availableNow=True))
    lines = spark.read.text(f"{path}/out")
    assert lines.count() == R.activity_events(spark, root).count()
    assert all(f.name.endswith(".txt.gz") for f in Path(f"{path}/out").rglob("part-*"))
    plain = real(spark, "archive")
    batch = R.activity_events(spark, root)
    sinks.archive_writer(f"{plain}/out", "event_timestamp", "none")(batch, 0)
    sinks.archive_writer(f"{path}/batch", "event_timestamp")(batch, 0)
    same = spark.read.text(f"{path}/batch").select("value")
    assert same.exceptAll(spark.read.text(f"{plain}/out").select("value")).isEmpty() and same.count() == lines.count()
    assert on_disk(f"{path}/batch") < on_disk(f"{plain}/out")


def test_more_rows_make_more_files_and_no_larger_tasks(spark, root, monkeypatch):
    rows = R.activity_events(spark, root).count()
    monkeypatch.setattr(scans, "FILE_ROWS", rows // 8)
    path, each = streams.json_folder(spark, root)
    sizes = [r["n"] for r in spark.read.text(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == rows and each >= 2 and len(sizes) >= 8 and max(sizes) < rows / 4


def test_bad_lines_of_folders_in_many_files(spark, root, monkeypatch):
    monkeypatch.setattr(scans, "FILE_ROWS", R.activity_events(spark, root).count() // 16)
    path = scans.folder_with_bad_lines(spark, root)
    files = spark.read.text(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(files) >= 16 and max(f["n"] for f in files) < sum(f["n"] for f in files) / 8
    verdict, detail = compare(spark, connect(root), root, "js4_bad_lines", QUERIES["js4_bad_lines"], ORACLES["js4_bad_lines"])
    assert verdict == "ok", detail
