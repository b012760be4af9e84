"""Mergeable summaries kept as a column: quantiles of latencies, sets of customers.

A sketch is made once per day (or pane) and group, in every task before the shuffle, and stored next
to its additive totals. Any longer range is a merge of stored rows, so reading a year touches some
hundred rows per group and no sample. Sketches are random within their error bounds; up to their
size they are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch, and the rank error that holds for a quantile in 99 of 100 cases.
QUANTILE_SIZE, RANK_ERROR = 800, 0.0045
#: log2 of the values a set sketch holds, and three standard errors of a count beyond that many.
SET_SIZE_LOG2 = 12
SET_ERROR = 3 / 2 ** (SET_SIZE_LOG2 / 2)
POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


# ---- quantiles of latencies ------------------------------------------------------------
def daily_latencies(samples: DataFrame, size: int = QUANTILE_SIZE) -> DataFrame:
    """Latency samples (see ``metrics.observe_latency``) as one row per day and metric, to be stored.

    Null and negative values are no samples; a sample without a time is kept under a null day.
    """
    return (
        samples.filter(F.col("value") >= 0)
        .groupBy(F.to_date("timestamp").alias("day"), "name")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.sum("value").alias("total_ms"),
            F.max("value").alias("max_ms"),
            F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"),
        )
    )


def merged_latencies(stored: DataFrame, *keys: Column | str) -> DataFrame:
    """Stored rows merged per metric and ``keys``, say ``F.date_trunc('month', 'day')``; still mergeable."""
    return stored.groupBy(*keys, "name").agg(
        F.sum("samples").alias("samples"),
        F.sum("total_ms").alias("total_ms"),
        F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def latency_report(merged: DataFrame, points: dict[str, float] | None = None) -> DataFrame:
    """Mean, maximum and percentiles of merged rows; percentiles are values that occur in the samples."""
    points = POINTS if points is None else points
    shown = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for n, p in points.items()]
    kept = [c for c in merged.columns if c not in ("total_ms", "max_ms", "sketch")]
    return merged.select(*kept, (F.col("total_ms") / F.col("samples")).alias("mean_ms"), "max_ms", *shown)


def share_within(report: DataFrame, milliseconds: Column | float) -> DataFrame:
    """Share of samples of at most so many milliseconds, per merged row: a service level without a scan."""
    limit = milliseconds if isinstance(milliseconds, Column) else F.lit(float(milliseconds))
    return report.withColumn("share_within", F.kll_sketch_get_rank_double("sketch", limit))


def rank_errors(
    report: DataFrame, samples: DataFrame, keys: Sequence[str], points: dict[str, float] | None = None
) -> DataFrame:
    """``<point>_error``: how far the exact ranks of a reported value are from the wanted rank.

    The ranks of a value are the interval from the share of smaller samples to the share of those not larger.
    """
    points = POINTS if points is None else points
    on = [*keys, "name"]
    values = samples.filter(F.col("value") >= 0).select(*on, "value").join(report, on)
    counts = [F.count(F.lit(1)).alias("_n")]
    for name in points:
        counts += [F.count_if(F.col("value") < F.col(name)).alias(f"_below_{name}"),
                   F.count_if(F.col("value") <= F.col(name)).alias(f"_upto_{name}")]
    ranks = values.groupBy(*on).agg(*counts)
    gap = lambda n, p: F.greatest(
        F.lit(0.0), F.col(f"_below_{n}") / F.col("_n") - p, F.lit(p) - F.col(f"_upto_{n}") / F.col("_n"))
    return ranks.select(*on, *[gap(n, p).alias(f"{n}_error") for n, p in points.items()])


# ---- sets of customers -----------------------------------------------------------------
def customer_sets(events: DataFrame, *keys: Column | str, member: str = "customer_id") -> DataFrame:
    """Events and a set sketch of their customers per group, to be stored; nulls are no customers."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.theta_sketch_agg(F.col(member), F.lit(SET_SIZE_LOG2)).alias("customers"),
    )


def united_sets(stored: DataFrame, *keys: Column | str) -> DataFrame:
    """Stored rows united per ``keys``; a customer of several rows counts once."""
    return stored.groupBy(*keys).agg(
        F.sum("event_count").alias("event_count"),
        F.theta_union_agg("customers", F.lit(SET_SIZE_LOG2)).alias("customers"),
    )


def set_sizes(stored: DataFrame, name: str = "unique_customers") -> DataFrame:
    return stored.withColumn(name, F.theta_sketch_estimate("customers")).drop("customers")


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Customers in both of two groups and in the left one only, from stored sets; a missing right side is empty."""
    pairs = left.select(*keys, F.col("customers").alias("_l")).join(
        right.select(*keys, F.col("customers").alias("_r")), list(keys), "left")
    in_left = F.theta_sketch_estimate("_l")
    both = F.when(F.col("_r").isNull(), 0).otherwise(F.theta_sketch_estimate(F.theta_intersection("_l", "_r")))
    only = F.when(F.col("_r").isNull(), in_left).otherwise(F.theta_sketch_estimate(F.theta_difference("_l", "_r")))
    return pairs.select(*keys, both.cast("long").alias("in_both"), only.cast("long").alias("in_left_only"))
