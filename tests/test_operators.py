"""Behaviour the oracles cannot show: skew, retries, errors, plans."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import alerts, joins, refine, skew, typed
from tallyhouse.operators import windows as W
from tallyhouse.operators.aggregates import bykey, daily, sales
from tallyhouse.schemas import EVENT, struct
from tallyhouse.session import scratch
from tallyhouse.sinks import files
from tallyhouse.sinks.keyed import KeyedTable, definitions_for_creation
from tallyhouse.sources import readers
from tallyhouse.sources import relational as R

SMALL = skew.SkewPolicy(min_rows=20, share=0.0, salts=4)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---- balanced joins ------------------------------------------------------------
@pytest.fixture(scope="module")
def hot_sides(spark):
    """A third of the left rows on one key, many null keys, keys missing on both sides."""
    left = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 5 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        F.col("id").alias("a"))
    right = spark.range(70).select(
        F.when(F.col("id") < 3, F.lit("hot")).when(F.col("id") == 60, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
        (F.col("id") * 10).alias("b"))
    return left, right


def brute(left, right, how):
    lrows, rrows = [tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()]
    out, used = [], set()
    for k, a in lrows:
        found = [i for i, (rk, _) in enumerate(rrows) if k is not None and rk == k]
        used.update(found)
        if how == "left_semi":
            out += [(k, a)] if found else []
        elif how == "left_anti":
            out += [] if found else [(k, a)]
        else:
            out += [(k, a, rrows[i][1]) for i in found]
            if not found and how in ("left", "full"):
                out.append((k, a, None))
    if how in ("right", "full"):
        out += [(rk, None, b) for i, (rk, b) in enumerate(rrows) if i not in used]
    return Counter(out)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize("policy", [SMALL, skew.DEFAULT])
def test_balanced_join_equals_brute_force(hot_sides, how, policy):
    left, right = hot_sides
    heavy = skew.find_heavy_keys(right if how == "right" else left, "k", policy)
    assert bool(heavy) == (policy is SMALL and how != "right")
    got = skew.balanced_join(left, right, "k", how, heavy, policy)
    assert Counter(tuple(r) for r in got.collect()) == brute(left, right, how)


def test_heavy_keys_are_found_and_spread(hot_sides):
    left, right = hot_sides
    heavy = skew.find_heavy_keys(left, "k", SMALL)
    assert "hot" in heavy.values and heavy.nulls and len(heavy.values) < 200
    spread = left.filter(F.col("k") == "hot").select(skew._row_salt(left, 4).alias("s")).distinct().count()
    assert spread == 4
    assert not skew.find_heavy_keys(left, "k")


def test_orphans_with_skew(hot_sides):
    left, right = hot_sides
    heavy = skew.find_heavy_keys(left, "k", SMALL)
    got = joins.orphans(left, right, "k", "k", heavy, SMALL)
    assert Counter(tuple(r) for r in got.collect()) == brute(left, right, "left_anti")


def test_joins_start_no_job_while_they_are_built(spark, hot_sides):
    left, right = hot_sides
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    for how in joins.ENRICH_TYPES:
        joins.enrich(left, right, "k", "k", how, joins.ENRICH_TYPES)
    joins.orphans(left, right, "k", "k")
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_join_rejects_unknown_types_and_shared_columns(hot_sides):
    left, right = hot_sides
    with pytest.raises(ValueError, match="join type"):
        joins.join_orders_customers(left, right, "cross", "k", "k")
    with pytest.raises(ValueError, match="both sides"):
        joins.enrich(left, left, "k", "k", "inner", joins.ENRICH_TYPES)
    with pytest.raises(ValueError, match="missing"):
        joins.orphans(left, right, "no", "k")


def test_summaries_never_build_pairs(spark):
    """One order with 200 sale rows and 200 delivery rows: 40,000 pairs, counted only."""
    sales_rows = spark.range(200).select(
        F.lit("o1").alias("order_id"), F.lit("1.10").cast("decimal(14,2)").alias("total_amount"))
    moves = spark.range(200).select(
        F.lit("o1").alias("order_id"), F.lit("failed").alias("status"),
        F.lit(True).alias("late"), (F.col("id") * 1.0).alias("delivery_delay_hours"))
    out = joins.create_logistics_sales_summary(sales_rows, moves).first()
    assert (out.sales_count, out.total_sales_amount, out.average_sale_amount) == (40_000, 44_000.0, 1.1)
    perf = joins.create_delivery_performance_summary(sales_rows, moves).first()
    assert perf.late_delivery_count == 40_000 and perf.average_delivery_delay_hours == 99.5


# ---- dedupe --------------------------------------------------------------------------
def test_duplicates_are_cut_before_the_shuffle(spark, root):
    df = refine.drop_duplicates(R.order_events(spark, root))
    plan = plan_of(df)
    partial = plan.index("Partial")
    assert "WindowGroupLimit" in plan and plan.rindex("Exchange", 0, partial) < partial
    again = refine.drop_duplicates(R.order_events(spark, root).repartition(7))
    assert sorted(map(str, df.collect())) == sorted(map(str, again.collect()))


def test_hot_duplicate_key_keeps_the_earliest(spark):
    rows = spark.range(5000).select(
        F.lit("same").alias("event_id"), F.timestamp_seconds(F.col("id") + 100).alias("ingestion_timestamp"), "id")
    assert [r.id for r in refine.drop_duplicates(rows).collect()] == [0]


# ---- plans ----------------------------------------------------------------------------
def test_scan_reads_only_needed_columns_and_pushes_filters(spark, root):
    plan = plan_of(sales.aggregate_by_status(R.all_events(spark, root), ordered=False))
    assert "l_shipdate" not in plan and "BatchScan" not in plan.replace("BatchEvalPython", "")
    clicks = plan_of(R.click_events(spark, root))
    assert "PushedFilters: [In(event_type" in clicks
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_daily_mart_has_one_shuffle_without_order(spark, root):
    plan = plan_of(daily.aggregate_sales_by_day(R.activity_events(spark, root), ordered=False))
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan


# ---- windows and watermarks -----------------------------------------------------------
def test_six_windows_cover_an_event(spark):
    one = spark.sql("SELECT 'e' AS event_id, TIMESTAMP '2026-09-12 22:01:00' AS event_timestamp")
    starts = [r.window_start for r in W.assign_events(one).orderBy("window_start").collect()]
    first = dt.datetime(2026, 9, 12, 22, 0, 10)
    assert starts == [first + dt.timedelta(seconds=10 * i) for i in range(6)]
    row = one.select(W.calculate_window_start("event_timestamp").alias("early"),
                     W.window_start_floor("event_timestamp").alias("late")).first()
    assert (row.early, row.late) == (starts[0], starts[-1])
    with pytest.raises(ValueError):
        W.sliding("event_timestamp", 10, 20)


def test_lateness_labels(spark):
    rows = [(0, 0), (100, 100), (91, 101), (85, 102), (75, 103)]
    df = spark.createDataFrame(rows, "e LONG, i LONG").select(
        F.timestamp_seconds("e").alias("event_timestamp"), F.timestamp_seconds("i").alias("ingestion_timestamp"), "e")
    got = {r.e: r.lateness for r in W.label_lateness(df).collect()}
    assert got == {0: "on_time", 100: "on_time", 91: "on_time", 85: "allowed", 75: "dropped"}


def test_unknown_type_needs_open_vocabulary(spark):
    df = spark.sql("SELECT 'x' AS customer_id, 'refund' AS event_type, 1 AS quantity, "
                   "CAST(1 AS DECIMAL(14,2)) AS total_amount, TIMESTAMP '2026-01-01' AS event_timestamp")
    with pytest.raises(Exception, match="outside the vocabulary"):
        W.aggregate_events(df).collect()
    assert W.aggregate_events(df, vocabulary=None).first().event_type == "refund"


def test_keyed_windows_refuse_blank_keys(spark):
    df = spark.sql("SELECT ' ' AS customer_id, TIMESTAMP '2026-01-01' AS event_timestamp")
    with pytest.raises(Exception, match="usable customer_id"):
        W.assign_events_by_key(df).collect()


def test_empty_frame_has_no_aggregate(spark):
    assert W.aggregate_events(spark.createDataFrame([], EVENT)).collect() == []


# ---- keyed table ----------------------------------------------------------------------
def test_keyed_table_replay_changes_nothing(spark):
    table = KeyedTable(spark, scratch(spark, "kt"), struct("row_key STRING, kind STRING"))
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "row_key STRING, kind STRING")
    table.upsert(rows(("a", "1"), ("b", "1")), 0)
    table.upsert(rows(("b", "2")), 1)
    table.upsert(rows(("b", "2")), 1)
    assert {r.row_key: r.kind for r in table.read().collect()} == {"a": "1", "b": "2"}
    table.upsert(rows(("a", "0")), 0)  # a replay of an old version does not undo a newer one
    assert table.get("b").first().kind == "2"
    table.delete(rows(("a", "")), 2)
    assert [r.row_key for r in table.scan("a", "z", limit=5).collect()] == ["b"]
    assert "PushedFilters: [IsNotNull(row_key), EqualTo(row_key,b)" in plan_of(table.get("b"))


def test_keyed_definitions():
    tables = definitions_for_creation()
    assert tables["ecommerce_alerts"].fieldNames() == ["row_key", "alert", "event", "metric"]


# ---- alerts, transforms, files -----------------------------------------------------------
def test_rules_are_checked():
    with pytest.raises(TypeError):
        alerts.register_rule([], "rule")
    with pytest.raises(ValueError):
        alerts.high_sales_volume(0)


def test_typed_view_drops_foreign_columns(spark, root):
    view = typed.typed_view(R.all_events(spark, root), "order")
    assert "carrier" not in view.columns and "total_amount" in view.columns


def test_bad_arguments(spark, root):
    with pytest.raises(ValueError):
        readers.read_json(spark, "  ")
    with pytest.raises(ValueError, match="does not exist"):
        readers.read_table(spark, "no_such_table")
    with pytest.raises(ValueError):
        files.write_parquet(spark.range(1), scratch(spark, "x"), partition_by=["nope"])
    with pytest.raises(ValueError):
        bykey.top_keys(spark.range(1), 0)
    with pytest.raises(ValueError):
        W.filter_by_event_type(spark.range(1), {"refund"})


def test_bad_json_line_fails_the_strict_reader(spark):
    path = scratch(spark, "strict")
    spark.createDataFrame([('{"event_id": "a"}',), ("{broken",)], "value STRING").write.text(path)
    with pytest.raises(Exception):
        readers.read_json_records(spark, path).collect()


def test_archive_appends_and_never_overwrites(spark, root):
    path = scratch(spark, "archive")
    few = R.activity_events(spark, root).filter(F.col("event_timestamp") < "2024-01-02")
    files.write_event_archive(few, path)
    files.write_event_archive(few, path)
    assert spark.read.text(path).count() == 2 * few.count()


def test_pane_windows_do_not_copy_events(spark, root):
    """Events are combined per pane before anything is laid out, and the only wide rows are pieces of panes."""
    for key in (None, "customer_id"):
        plan = W.process(R.activity_events(spark, root), key_field=key, ordered=False)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in text
        below = text[text.rindex("Generate explode"):] if "Generate explode" in text else text
        assert "partial_count" in below  # the first aggregation lies below the lowest expansion


def events_at(spark, rows):
    schema = "event_timestamp timestamp, event_type string, customer_id string, shop string, quantity int, total_amount decimal(14,2)"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("size,slide", [(60, 10), (60, 60), (90, 40), (7200, 1800), (10, 3)])
def test_pane_windows_equal_windows_of_copied_events(spark, size, slide):
    rng = random.Random(size + slide)
    start = dt.datetime(2024, 3, 1, 23, 50, 0, 250_000)
    rows = [
        (
            start + dt.timedelta(seconds=rng.choice([0, 1, 3, 600, 3599, 3600, 7000]) + rng.randrange(120)),
            rng.choice(["click", "cart", "order", None]),
            rng.choice(["a", "b", "c", None]),
            rng.choice(["x", "y"]),
            rng.choice([None, 1, 5]),
            rng.choice([None, "1.25", "-3.10"]),
        )
        for _ in range(400)
    ]
    rows = [(*r[:5], None if r[5] is None else Decimal(r[5])) for r in rows]
    rows += [(None, "click", "a", "x", 1, None), (dt.datetime(1969, 12, 31, 23, 59, 58), "click", "a", "x", 1, None)]
    df = events_at(spark, rows).repartition(3)
    known = df.filter("customer_id is not null")
    for frame, key in ((df, None), (df, "shop"), (known, "customer_id")):
        cases = [W.process(frame, size, slide, key_field=key, ordered=False, vocabulary=v) for v in (W.EVENT_TYPES, None)]
        new, old = (sorted(map(repr, c.collect())) for c in cases)
        assert new == old and new


def test_bad_lines_are_numbered_over_many_splits(spark):
    """Lines of very unlike lengths, files cut into many splits, blank lines counted, no line of a good file listed."""
    path = scratch(spark, "lines")
    rng = random.Random(4)
    want, texts = [], []
    for f in range(3):
        lines = []
        for k in range(4000):
            kind = rng.randrange(10) if f else 9
            lines.append(["{no", "7", "", "   "][kind] if kind < 4 else '{"event_id": "%s"}' % ("x" * rng.randrange(300)))
            if kind < 2:
                want.append((f, k + 1, lines[-1]))
        texts.append((f, "\n".join(lines)))
    df = spark.createDataFrame(texts, "f int, value string").repartition(3, "f")
    df.write.partitionBy("f").text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        bad = readers.bad_lines(spark, path).select(F.regexp_extract("file", r"f=(\d)", 1).cast("int"), "line_number", "value")
        assert sorted(map(tuple, bad.collect())) == sorted(want)
        with pytest.raises(ValueError, match=f"line {min(w for w in want if w[0] == 1)[1]}: no JSON object"):
            readers.read_jsonl_checked(spark, f"{path}/f=1")
        good = readers.read_jsonl_checked(spark, f"{path}/f=0", struct("event_id STRING"))
        assert good.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
