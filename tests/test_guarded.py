"""Guarded expressions: values, failures, and rules that fail on some rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.guarded import guard
from tallyhouse.operators import alerts as A


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, 10, 2, "7", ["a", "b"]), (2, 10, 0, "x", ["a"]), (3, None, 0, None, None), (4, 2**31 - 1, 1, " 8 ", [])]
    return spark.createDataFrame(rows, "id INT, a INT, b INT, text STRING, list ARRAY<STRING>")


def shown(frame, guarded):
    rows = frame.select("id", guarded.value.alias("v"), guarded.error.alias("e")).collect()
    return {r["id"]: (r["v"], r["e"]) for r in rows}


def test_steps_fail_for_their_row_only(frame):
    a, b = guard(F.col("a")), guard(F.col("b"))
    assert shown(frame, a / b) == {
        1: (5.0, None), 2: (None, "division by zero"), 3: (None, None), 4: (2.0**31 - 1, None)}
    assert shown(frame, a % b)[2] == (None, "division by zero")
    assert shown(frame, a + b)[4] == (None, "sum out of range")
    assert shown(frame, a * b)[4] == (2**31 - 1, None)
    assert shown(frame, a - b)[2] == (10, None)
    assert shown(frame, guard(F.col("text")).cast("int")) == {
        1: (7, None), 2: (None, "not a int: x"), 3: (None, None), 4: (8, None)}
    items = shown(frame, guard(F.col("list")).item(2))
    assert items == {1: ("b", None), 2: (None, "no item 2"), 3: (None, None), 4: (None, "no item 2")}
    assert shown(frame, guard(F.col("list")).item(-1))[1] == ("b", None)
    assert shown(frame, guard(F.col("text")).required("text"))[3] == (None, "text is missing")
    with pytest.raises(ValueError):
        guard(F.col("list")).item(0)


def test_the_first_failure_is_handed_on(frame):
    later = (guard(F.col("a")) / guard(F.col("b"))) + guard(F.col("text")).cast("double")
    assert shown(frame, later)[2] == (None, "division by zero")
    assert shown(frame, later.map(lambda v: F.coalesce(v, F.lit(0.0))))[2] == (None, "division by zero")


def test_logic_needs_no_side_that_does_not_count(frame):
    fails = guard(F.col("a")) / guard(F.col("b")) > 1.0
    yes, no = guard(F.lit(True)), guard(F.lit(False))
    for pair in (no & fails, fails & no):
        assert shown(frame, pair)[2] == (False, None)
    for pair in (yes | fails, fails | yes):
        assert shown(frame, pair)[2] == (True, None)
    for pair in (yes & fails, fails | no, ~fails):
        assert shown(frame, pair)[2] == (None, "division by zero")
    assert shown(frame, yes & fails)[1] == (True, None)
    assert shown(frame, yes & fails)[3] == (None, None)


def rules():
    ratio = guard(F.col("a")) / guard(F.col("b"))
    number = guard(F.col("text")).cast("int")
    name = lambda n: {"alert_id": F.concat(F.lit(n), F.col("id").cast("string"))}
    return [
        A.AlertRule("RATIO", "INFO", ratio > 1.0, name("r")),
        A.AlertRule("PLAIN", "INFO", F.col("id") >= 1, name("p")),
        A.AlertRule("BUILT", "INFO", F.col("id") <= 3, {**name("b"), "message": number.map(lambda n: n.cast("string"))}),
    ]


def test_other_rules_stand(frame):
    found = {r["alert_id"] for r in A.detect(frame, rules()).collect()}
    assert found == {"r1", "r4", "p1", "p2", "p3", "p4", "b1", "b3"}
    failed = {tuple(r) for r in A.failures(frame, rules(), "id").collect()}
    assert failed == {(2, "RATIO", "division by zero"), (2, "BUILT", "not a int: x")}


def test_plain_rules_and_empty_frames(frame):
    assert A.failures(frame, [rules()[1]], "id").count() == 0
    assert A.failures(frame.limit(0), rules(), "id").count() == 0
    assert A.failures(frame, rules(), "id").columns == A.failures(frame, [rules()[1]], "id").columns


def test_failures_of_a_stream(spark, frame, tmp_path):
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    running = A.failures(stream, rules(), "id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    running.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
