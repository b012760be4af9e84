"""Published loads and incremental marts: audits, conflicts, rollback, retention, what is read."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.skew import HeavyKeys
from tallyhouse.plans import copartition
from tallyhouse.plans.incremental import IncrementalMart
from tallyhouse.queries.loads import AGAIN, loaded_mart
from tallyhouse.session import scratch
from tallyhouse.sinks.published import AuditFailed, Conflict, Manifest, Published

SCHEMA = "day string, shop string, customer string, amount decimal(14,2), pieces int"


def rows(spark, *items):
    return spark.createDataFrame([(d, s, c, None if a is None else Decimal(a), p) for d, s, c, a, p in items], SCHEMA)


def shown(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.fixture
def store(spark):
    return Published(spark, scratch(spark, "published"))


def rules():
    return {"positive": F.col("amount") > 0, "known": F.col("customer").isNotNull()}


def test_failed_audit_is_not_visible(spark, store):
    first = rows(spark, ("d1", "a", "x", "1.00", 1), ("d2", "a", "y", "2.00", 1))
    assert store.load("sales", first, "day", rules()) == 1
    bad = rows(spark, ("d2", "a", "y", "3.00", 1), ("d3", "a", None, "-1.00", 1), ("d3", "a", "z", None, 1))
    with pytest.raises(AuditFailed) as e:
        store.load("sales", bad, "day", rules())
    assert e.value.failed == {"positive": 2, "known": 1}
    assert store.versions() == [1] and shown(store.read("sales")) == shown(first)


def test_partitions_are_replaced_in_one_step_and_rolled_back(spark, store):
    store.load("sales", rows(spark, ("d1", "a", "x", "1.00", 1), ("d2", "a", "y", "2.00", 1)), "day")
    store.view("sales_view_of_test", "sales")
    second = rows(spark, ("d2", "b", "z", "5.00", 2), ("d'3 %", "b", "z", "6.00", 2))
    assert store.load("sales", second, "day") == 2
    want = shown(rows(spark, ("d1", "a", "x", "1.00", 1)).unionByName(second))
    assert shown(store.read("sales")) == want
    assert len(shown(spark.table("sales_view_of_test"))) == 2  # the view shows its version until it is moved
    store.view("sales_view_of_test", "sales")
    assert sorted(shown(spark.table("sales_view_of_test").select(*store.read("sales").columns))) == want
    spark.sql("DROP VIEW sales_view_of_test")
    assert store.rollback(1) == 3
    assert [r["shop"] for r in store.read("sales").collect()] == ["a", "a"]
    assert shown(store.read("sales", store.manifest(2))) == want


def test_the_second_of_two_writers_fails(spark, store):
    store.load("sales", rows(spark, ("d1", "a", "x", "1.00", 1)), "day")
    base = store.manifest()
    mine, other = (store.stage("sales", rows(spark, ("d1", s, "x", "1.00", 1)), "day") for s in "mo")
    store.publish(mine, base=base)
    with pytest.raises(Conflict):
        store.publish(other, base=base)
    assert [r["shop"] for r in store.read("sales").collect()] == ["m"]


def test_a_manifest_cut_short_is_passed_over(spark, store):
    store.load("sales", rows(spark, ("d1", "a", "x", "1.00", 1)), "day")
    place, fs = store._at("manifest", "v000000002.json")
    fs.create(place, False).close()
    assert store.manifest().version == 1 and len(store.read("sales").collect()) == 1


def test_expired_loads_go_and_used_ones_stay(spark, store):
    for k in range(3):
        store.load("sales", rows(spark, ("d1", "a", str(k), "1.00", 1), (f"e{k}", "a", str(k), "1.00", 1)), "day")
    assert store.expire(keep=1) == []  # all of them are younger than the grace time
    before = shown(store.read("sales"))
    assert store.expire(keep=1, grace_seconds=-1) == []  # every load still holds a partition of its own
    store.publish(base=store.manifest(), drop=[("sales", "day=e0")])
    assert len(store.expire(keep=1, grace_seconds=-1)) == 1
    assert len(shown(store.read("sales"))) == len(before) - 1


def test_empty_load_and_empty_table(spark, store):
    none = rows(spark).filter("false")
    store.load("sales", none, "day", rules())
    assert store.read("sales").columns == none.columns and store.read("sales").collect() == []


def mart_of(spark):
    return IncrementalMart(
        Published(spark, scratch(spark, "mart")),
        "m",
        ["shop"],
        {"amount": F.col("amount"), "pieces": F.col("pieces").cast("long")},
        {"customers": F.col("customer")},
        "day",
    )


def recomputed(df):
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("amount", "pieces")]
    return df.groupBy("shop").agg(F.count(F.lit(1)).alias("row_count"), *sums, F.count_distinct("customer").alias("customers"))


def test_mart_follows_loads_reloads_and_withdrawals(spark):
    mart = mart_of(spark)
    day1 = rows(spark, ("d1", "a", "x", "1.00", 1), ("d1", "a", "x", None, None), ("d1", None, "y", "2.00", 1), ("d1", "b", None, "2.00", 1))
    day2 = rows(spark, ("d2", "a", "x", "4.00", 1), ("d2", "c", "z", "4.00", 1))
    day2b = rows(spark, ("d2", "a", "w", "4.00", 7))
    mart.apply(day1)
    mart.apply(day2)
    assert shown(mart.read()) == shown(recomputed(day1.unionByName(day2)))
    mart.apply(day2b)  # shop c is gone; x is still a customer of a by day 1
    assert shown(mart.read()) == shown(recomputed(day1.unionByName(day2b)))
    mart.fold()
    assert shown(mart.read()) == shown(recomputed(day1.unionByName(day2b)))
    mart.apply(rows(spark).filter("false"), emptied=["day=d1"])
    assert shown(mart.read()) == shown(recomputed(day2b))
    mart.apply(day1)
    with pytest.raises(AuditFailed):
        mart.apply(day2, rules={"few": F.col("pieces") < 1})
    assert shown(mart.read()) == shown(recomputed(day1.unionByName(day2b)))
    by_day = mart.read_by_partition(parts=["day=d2"])
    assert [(r["day"], r["shop"], r["customers"]) for r in by_day.collect()] == [("d2", "a", 1)]


def test_a_load_reads_no_other_partition(spark, root):
    mart = loaded_mart(spark, root)
    store = mart.store
    opened = []
    read = store.read

    def watched(table, base=None, parts=None):
        df = read(table, base, parts)
        opened.extend(df.inputFiles())
        return df

    store.read = watched
    from tallyhouse.queries.loads import between, orders

    mart.apply(between(orders(spark, root), "1995-03", "1995-04"))
    months = {f.split("month=")[1].split("/")[0] for f in opened if "month=" in f}
    assert months == {"1995-03"} and AGAIN[0] < "1995-03"
    assert isinstance(store.manifest(), Manifest)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("heavy", [(), ("1", "7")])
def test_copartitioned_join_has_no_shuffle_above_the_buckets(spark, no_broadcast, how, heavy):
    left = spark.range(400).selectExpr("IF(id % 10 = 3, NULL, CAST(IF(id % 3 = 0, 1, id % 60) AS STRING)) AS k", "id AS a").repartition(3)
    right = spark.range(90).selectExpr("IF(id % 11 = 0, NULL, CAST(id % 80 AS STRING)) AS k", "id AS b").repartition(2)
    path = scratch(spark, "tables")
    tag = path.rsplit("-", 1)[1]
    layout = copartition.Layout("k", 4, HeavyKeys(heavy, True))
    for name, df in (("l", left), ("r", right)):
        copartition.store(df, layout, f"{name}_{tag}", path=path)
    joined = copartition.join(spark, f"l_{tag}", f"r_{tag}", layout, how)
    assert shown(joined) == shown(left.join(right, "k", how))
    grouped = joined.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert shown(grouped) == shown(left.join(right, "k", how).groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    buckets = spark.table(f"l_{tag}").join(spark.table(f"r_{tag}"), "k", how)
    assert exchanges(buckets) == 0
    assert exchanges(left.join(right, "k", how)) > 0
    sums = copartition.per_key(spark, f"l_{tag}", layout, [F.sum("a").alias("a")])
    assert shown(sums) == shown(left.groupBy("k").agg(F.sum("a").alias("a")))
    assert exchanges(spark.table(f"l_{tag}").groupBy("k").agg(F.sum("a"))) == 0
    assert shown(copartition.rows(spark, f"l_{tag}")) == shown(left)
    for name in ("l", "r"):
        copartition.drop(spark, f"{name}_{tag}")
