"""Sliding windows and lateness on batch frames, and aggregates over whole frames.

The streaming job uses the same window and aggregate expressions, so a replayed
stream and the batch result agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import MONEY, as_col, filled, merge_maps, require, seconds_between
from ..functions.timestamps import floor_timestamp
from ..schemas import EVENT_TYPES
from . import panes

SIZE_SECONDS, SLIDE_SECONDS = 60, 10
OUT_OF_ORDERNESS_SECONDS = 10
ALLOWED_LATENESS_SECONDS = 10


def check_window(size_seconds: int, slide_seconds: int) -> None:
    if size_seconds <= 0 or slide_seconds <= 0:
        raise ValueError("window size and slide must be positive")
    if slide_seconds > size_seconds:
        raise ValueError("slide must not exceed size")


def sliding(
    ts: Column | str = "event_timestamp",
    size_seconds: int = SIZE_SECONDS,
    slide_seconds: int = SLIDE_SECONDS,
) -> Column:
    check_window(size_seconds, slide_seconds)
    return F.window(as_col(ts), f"{size_seconds} seconds", f"{slide_seconds} seconds")


def window_start_floor(ts: Column | str, slide_seconds: int = SLIDE_SECONDS) -> Column:
    """Latest start of a window that covers the event."""
    return floor_timestamp(ts, slide_seconds)


def calculate_window_start(
    ts: Column | str, size_seconds: int = SIZE_SECONDS, slide_seconds: int = SLIDE_SECONDS
) -> Column:
    """Earliest start among the ``size // slide`` windows of the event."""
    check_window(size_seconds, slide_seconds)
    back = (size_seconds // slide_seconds - 1) * slide_seconds
    latest = F.unix_seconds(floor_timestamp(ts, slide_seconds))
    return F.timestamp_seconds(F.greatest(F.lit(0), latest - back))


def calculate_window_end(start: Column | str, size_seconds: int = SIZE_SECONDS) -> Column:
    return as_col(start) + F.expr(f"INTERVAL {int(size_seconds)} SECONDS")


def is_event_in_window(
    ts: Column | str, start: Column | str, size_seconds: int = SIZE_SECONDS
) -> Column:
    moment = as_col(ts)
    return (moment >= as_col(start)) & (moment < calculate_window_end(start, size_seconds))


def contains(ts: Column | str, start: Column | str, end: Column | str) -> Column:
    moment = as_col(ts)
    return (moment >= as_col(start)) & (moment < as_col(end))


def assign_events(
    df: DataFrame, size_seconds: int = SIZE_SECONDS, slide_seconds: int = SLIDE_SECONDS
) -> DataFrame:
    """One row per event and covering window: a narrow expansion, no shuffle."""
    return (
        df.withColumn("_window", sliding("event_timestamp", size_seconds, slide_seconds))
        .withColumns({"window_start": F.col("_window.start"), "window_end": F.col("_window.end")})
        .drop("_window")
    )


def with_key(df: DataFrame, key_field: str) -> DataFrame:
    """``key`` from a column; a row without one is an error, as it is in a keyed stream."""
    if not key_field.strip():
        raise ValueError("key_field must not be blank")
    require(df, key_field)
    key = F.when(filled(key_field), F.col(key_field)).otherwise(
        F.raise_error(F.lit(f"event without a usable {key_field}"))
    )
    return df.withColumn("key", key)


def assign_events_by_key(
    df: DataFrame,
    key_field: str = "customer_id",
    size_seconds: int = SIZE_SECONDS,
    slide_seconds: int = SLIDE_SECONDS,
) -> DataFrame:
    """Window rows with their key."""
    return assign_events(with_key(df, key_field), size_seconds, slide_seconds)


def iter_windows(
    df: DataFrame, size_seconds: int = SIZE_SECONDS, slide_seconds: int = SLIDE_SECONDS
) -> DataFrame:
    """Windows with their events in window order, one row per pair.

    Rows stay rows: a window with very many events is never packed into one
    array, and the range sort splits it over tasks by event time and id.
    """
    return assign_events(df, size_seconds, slide_seconds).orderBy(
        "window_start", "event_timestamp", "event_id"
    )


def unzero(value: Column, type_name: str) -> Column:
    return F.coalesce(value, F.lit(0).cast(type_name))


def event_type_or_mixed(types: Column) -> Column:
    """The single type of the group, else ``mixed``; types are a small vocabulary."""
    return F.when(F.size(types) == 1, types[0]).otherwise(F.lit("mixed"))


def type_bits(vocabulary: Sequence[str]) -> Column:
    """One bit per type, so the types of a group are a ``bit_or``: one long of state.

    A type outside the vocabulary is an error here rather than a wrong answer.
    """
    problem = F.concat(F.lit("event type outside the vocabulary: "), F.col("event_type"))
    bit = F.raise_error(problem).cast("int")
    for position, name in enumerate(vocabulary):
        bit = F.when(F.col("event_type") == name, F.lit(1 << position)).otherwise(bit)
    return F.when(F.col("event_type").isNotNull(), bit)


def types_from_bits(bits: Column, vocabulary: Sequence[str]) -> Column:
    pairs = sorted((name, 1 << position) for position, name in enumerate(vocabulary))
    return F.array_compact(
        F.array(*[F.when(bits.bitwiseAND(F.lit(value)) != 0, F.lit(name)) for name, value in pairs])
    )


def _rolled_up(
    df: DataFrame,
    keys: Sequence[str],
    span: bool = False,
    vocabulary: Sequence[str] | None = EVENT_TYPES,
) -> DataFrame:
    """Group totals with exact distinct customers, in two combining steps.

    First one row per group and customer, then one row per group. Both combine
    per task before they shuffle, so neither a hot window nor a hot customer
    gathers raw rows in one place. Without a vocabulary the types are kept as
    small sets, which any text fits into but which cost more.
    """
    if vocabulary is None:
        first, second = F.collect_set("event_type"), F.flatten(F.collect_set("_types"))
        types = F.array_sort(F.array_distinct(second))
    else:
        first = F.bit_or(type_bits(vocabulary))
        types = types_from_bits(F.bit_or("_types"), vocabulary)
    times = [F.min("event_timestamp").alias("_first"), F.max("event_timestamp").alias("_last")]
    spans = [F.min("_first").alias("window_start"), F.max("_last").alias("window_end")]
    per_customer = df.groupBy(*keys, "customer_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("quantity").cast("long")).alias("_q"),
        F.sum(F.col("total_amount").cast(MONEY)).alias("_a"),
        first.alias("_types"),
        *(times if span else []),
    )
    return per_customer.groupBy(*keys).agg(
        *(spans if span else []),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("event_count"),
        F.count("customer_id").alias("unique_customers"),
        unzero(F.sum("_q"), "long").alias("total_quantity"),
        unzero(F.sum("_a"), "decimal(24,2)").cast("decimal(24,2)").alias("total_amount"),
        types.alias("event_types"),
    )


def _window_metadata(size_seconds: int, slide_seconds: int) -> Column:
    return F.create_map(
        F.lit("window_type"),
        F.lit("sliding"),
        F.lit("window_size_seconds"),
        F.lit(str(size_seconds)),
        F.lit("window_slide_seconds"),
        F.lit(str(slide_seconds)),
    )


def process(
    df: DataFrame,
    size_seconds: int = SIZE_SECONDS,
    slide_seconds: int = SLIDE_SECONDS,
    key_field: str | None = None,
    ordered: bool = True,
    vocabulary: Sequence[str] | None = EVENT_TYPES,
) -> DataFrame:
    """Sliding aggregation, global or per key, one row per window (and key).

    Windows are put together from panes (see :mod:`.panes`). Without a vocabulary the types are sets,
    from which nothing can be taken off; then each event is laid into all its windows.
    """
    check_window(size_seconds, slide_seconds)
    keys = [] if key_field is None else ["key"]
    if vocabulary is not None:
        if key_field is not None:
            df = with_key(df, key_field)
        own = key_field == "customer_id"
        out = panes.windows(df, keys, vocabulary, size_seconds, slide_seconds, single_customer=own)
    else:
        if key_field is None:
            assigned = assign_events(df, size_seconds, slide_seconds)
        else:
            assigned = assign_events_by_key(df, key_field, size_seconds, slide_seconds)
        out = _rolled_up(assigned, ["window_start", "window_end", *keys], vocabulary=None)
    if key_field is None:
        out = out.withColumn("key", F.lit(None).cast("string"))
    out = out.select(
        "window_start",
        "window_end",
        event_type_or_mixed(F.col("event_types")).alias("event_type"),
        "event_count",
        "unique_customers",
        "total_quantity",
        "total_amount",
        "key",
        _window_metadata(size_seconds, slide_seconds).alias("metadata"),
    )
    return out.orderBy("window_start", *keys) if ordered else out


def process_by_key(df: DataFrame, key_field: str = "customer_id", **options) -> DataFrame:
    return process(df, key_field=key_field, **options)


# ---- whole-frame and keyed aggregates -----------------------------------
def aggregate_events(
    df: DataFrame, key_field: str | None = None, vocabulary: Sequence[str] | None = EVENT_TYPES
) -> DataFrame:
    """Time span, counts, amount and types of all rows, or of each non-blank key."""
    keys = []
    if key_field is not None:
        df, keys = df.filter(filled(key_field)).withColumn("key", F.col(key_field)), ["key"]
    out = _rolled_up(df, keys, span=True, vocabulary=vocabulary)
    if not keys:
        # an empty frame has nothing to describe: no row instead of a row of nulls
        out = out.withColumn("key", F.lit(None).cast("string")).filter(F.col("event_count") > 0)
    return out.select(
        "window_start",
        "window_end",
        event_type_or_mixed(F.col("event_types")).alias("event_type"),
        "event_count",
        "unique_customers",
        "total_quantity",
        "total_amount",
        "key",
        "event_types",
    )


def total_value(df: DataFrame) -> DataFrame:
    amount = unzero(F.sum(F.col("total_amount").cast(MONEY)), "decimal(24,2)")
    return df.agg(amount.cast("decimal(24,2)").alias("total_value"))


def count_events(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("event_count"))


def count_unique_customers(df: DataFrame) -> DataFrame:
    named = F.when(filled("customer_id"), F.col("customer_id"))
    return df.agg(F.count_distinct(named).alias("unique_customers"))


def average_ticket(df: DataFrame) -> DataFrame:
    """Mean of the non-null amounts to cents; 0.00 when there are none."""
    amount = F.col("total_amount").cast(MONEY)
    mean = F.round(F.try_divide(F.sum(amount), F.count(amount)), 2)
    return df.agg(F.coalesce(mean, F.lit(0)).cast("decimal(24,2)").alias("average_ticket"))


# ---- watermarks replayed on a batch -------------------------------------
def calculate_watermark(max_ts: Column | str, bound_seconds: int = OUT_OF_ORDERNESS_SECONDS) -> Column:
    return as_col(max_ts) - F.expr(f"INTERVAL {int(bound_seconds)} SECONDS")


def watermark_by_arrival(
    df: DataFrame,
    bound_seconds: int = OUT_OF_ORDERNESS_SECONDS,
    event_ts: str = "event_timestamp",
    arrival_ts: str = "ingestion_timestamp",
) -> DataFrame:
    """The watermark after each arrival instant: running max of event time minus the bound.

    A running max needs an order, which would mean one task. It is built from small levels
    instead: the max per arrival instant (combined per task), then the running max of the
    instants of a second, the seconds of a minute, the minutes of a day, and the days. No task
    of a level sees more than the units inside one unit of the level above; the last, over
    days, has one row per day of the calendar, whatever the number of events.
    """
    instants = df.groupBy(F.col(arrival_ts).alias("_at")).agg(F.max(event_ts).alias("_max"))
    inside = Window.partitionBy(F.date_trunc("second", "_at")).orderBy("_at")
    out = instants.withColumn("_running", F.max("_max").over(inside))
    units = instants
    for unit, above in (("second", "minute"), ("minute", "day"), ("day", None)):
        units = units.groupBy(F.date_trunc(unit, "_at").alias("_at")).agg(F.max("_max").alias("_max"))
        earlier = Window.partitionBy(F.date_trunc(above, "_at")) if above else Window
        earlier = earlier.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        carried = units.select(F.col("_at").alias("_unit"), F.max("_max").over(earlier).alias("_carried"))
        out = out.join(carried, F.date_trunc(unit, "_at") == F.col("_unit")).select(
            "_at", F.greatest("_running", "_carried").alias("_running")
        )
    return out.select(
        F.col("_at").alias(arrival_ts), calculate_watermark("_running", bound_seconds).alias("watermark")
    )


def with_time_metadata(
    df: DataFrame,
    event_ts: str = "event_timestamp",
    ingestion_ts: str = "ingestion_timestamp",
    zone: str = "UTC",
) -> DataFrame:
    """``metadata`` with both times in milliseconds, the delay in seconds and the zone."""
    times = F.create_map(
        F.lit("event_ms"), F.unix_millis(event_ts).cast("string"),
        F.lit("ingestion_ms"), F.unix_millis(ingestion_ts).cast("string"),
        F.lit("delay_seconds"), seconds_between(event_ts, ingestion_ts).cast("string"),
        F.lit("zone"), F.lit(zone),
    )
    own = F.col("metadata") if "metadata" in df.columns else F.lit(None).cast("map<string,string>")
    return df.withColumn("metadata", merge_maps(own, times))


def is_late(ts: Column | str, watermark: Column | str) -> Column:
    """Before the watermark; never late while there is no watermark yet."""
    return F.coalesce(as_col(ts) < as_col(watermark), F.lit(False))


def is_late_event(
    ts: Column | str, watermark: Column | str, lateness_seconds: int = ALLOWED_LATENESS_SECONDS
) -> Column:
    """Before the watermark by more than the allowed lateness."""
    return is_late(ts, calculate_watermark(watermark, lateness_seconds))


def is_within_allowed_lateness(
    ts: Column | str, watermark: Column | str, lateness_seconds: int = ALLOWED_LATENESS_SECONDS
) -> Column:
    return ~is_late_event(ts, watermark, lateness_seconds)


def is_after(watermark: Column | str, ts: Column | str) -> Column:
    return as_col(watermark) >= as_col(ts)


def lateness_label(
    ts: Column | str, watermark: Column | str, lateness_seconds: int = ALLOWED_LATENESS_SECONDS
) -> Column:
    """on_time, allowed (late but inside the lateness) or dropped."""
    return (
        F.when(is_late_event(ts, watermark, lateness_seconds), "dropped")
        .when(is_late(ts, watermark), "allowed")
        .otherwise("on_time")
    )


def label_lateness(
    df: DataFrame,
    bound_seconds: int = OUT_OF_ORDERNESS_SECONDS,
    lateness_seconds: int = ALLOWED_LATENESS_SECONDS,
) -> DataFrame:
    """Each row with the watermark of its arrival instant and its lateness label.

    The watermark side has one row per arrival instant, so the join never fans
    out; rows that share an instant are split by AQE's skew handling.
    """
    watermarks = watermark_by_arrival(df, bound_seconds)
    return df.join(watermarks, "ingestion_timestamp", "left").withColumn(
        "lateness", lateness_label("event_timestamp", "watermark", lateness_seconds)
    )


# ---- row filters ------------------------------------------------------------
def filter_by_event_type(df: DataFrame, event_types: Sequence[str] | None = None) -> DataFrame:
    """Rows of the given types; a type outside the contract is an error."""
    wanted = set(EVENT_TYPES if event_types is None else event_types)
    unknown = sorted(wanted - set(EVENT_TYPES))
    if unknown:
        raise ValueError(f"unsupported event types: {unknown}")
    return df.filter(F.col("event_type").isin(*sorted(wanted)))


def _filter_by_id(df: DataFrame, column: str, value: str) -> DataFrame:
    wanted = value.strip()
    if not wanted:
        raise ValueError(f"{column} must not be blank")
    return df.filter(F.col(column) == wanted)


def filter_by_customer(df: DataFrame, customer_id: str) -> DataFrame:
    return _filter_by_id(df, "customer_id", customer_id)


def filter_by_product(df: DataFrame, product_id: str) -> DataFrame:
    return _filter_by_id(df, "product_id", product_id)


def filter_valid_events(df: DataFrame) -> DataFrame:
    """Id, supported type, both times and a customer are all there."""
    return df.filter(
        filled("event_id")
        & F.col("event_type").isin(*EVENT_TYPES)
        & F.col("event_timestamp").isNotNull()
        & F.col("ingestion_timestamp").isNotNull()
        & filled("customer_id")
    )
