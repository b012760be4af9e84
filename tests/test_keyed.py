"""Keyed tables over a long run: what a fold replaces is removed, unfinished folds hide nothing."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallyhouse.schemas import struct
from tallyhouse.sinks.keyed import KeyedTable
from tallyhouse.streaming import sinks

ROW = struct("row_key STRING, kind STRING, event_timestamp STRING")


def batch(spark, *rows):
    return spark.createDataFrame([(k, v, "2024") for k, v in rows], "row_key STRING, kind STRING, event_timestamp STRING")


def current(table):
    return {(r["row_key"], r["kind"]) for r in table.read().collect()}


def test_retired_versions_are_those_a_settled_base_replaced(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW)
    assert table.retire(0) == []
    table.upsert(batch(spark, ("a", "1"), ("b", "1")), 0)
    table.delete(batch(spark, ("b", "")), 1)
    assert table.retire(0) == []  # nothing holds the rows of these versions
    table.compact(2)
    table.upsert(batch(spark, ("c", "3")), 3)
    assert table.retire(3600) == []  # readers may still use the older ones
    gone = table.retire(0)
    assert [int(n.split("-")[1]) for n in gone] == [0, 1]
    assert len(table.versions()) == 2 and current(table) == {("a", "1"), ("c", "3")}
    table.upsert(batch(spark, ("b", "4")), 4)
    assert current(table) == {("a", "1"), ("c", "3"), ("b", "4")}
    with pytest.raises(ValueError):
        table.retire(-1)


def test_a_base_whose_writer_died_is_not_used(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW)
    table.upsert(batch(spark, ("a", "1")), 0)
    table.compact(1)
    first = table.base()
    table.upsert(batch(spark, ("b", "2")), 2)
    dead = tmp_path / "t" / "version=000001-000000000003-9-batch"
    os.makedirs(dead)  # the folder is there before its rows are
    assert table.base() == first and current(table) == {("a", "1"), ("b", "2")}
    table.retire(0)
    assert current(table) == {("a", "1"), ("b", "2")}


def test_a_long_stream_keeps_few_versions(spark, tmp_path):
    table = sinks.alert_table(spark, str(tmp_path / "t"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name not in ROW.fieldNames()]
    rows = lambda df: df.select("row_key", "event_timestamp", *blank)
    write = sinks.keyed_writer(table, rows, compact_every=3, grace_seconds=0)
    most = 0
    for number in range(11):
        write(batch(spark, (f"k{number % 4}", ""), (f"n{number}", "")), number)
        most = max(most, len(table.versions()))
    assert most <= 4
    assert table.read().count() == 4 + 11
    before = {r["row_key"] for r in table.read().collect()}
    write(batch(spark, ("k2", ""), ("n10", "")), 10)  # the last batch again
    assert {r["row_key"] for r in table.read().collect()} == before


def test_older_versions_are_not_listed(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW)
    for number in range(3):
        table.upsert(batch(spark, (f"k{number}", "1")), number)
    table.compact(3)
    files = table.log().inputFiles()
    assert files and all("-9-batch" in f for f in files)
