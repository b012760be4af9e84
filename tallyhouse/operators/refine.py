"""Raw to clean: names, times, required fields, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.basics import filled, lower_trim, merge_maps, present
from ..schemas import REQUIRED_FIELDS


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def cast_timestamp_columns(
    df: DataFrame, columns: Sequence[str] = ("event_timestamp", "ingestion_timestamp")
) -> DataFrame:
    found = present(df, columns)
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in found}) if found else df


def remove_invalid_events(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Rows whose present required fields are all non-null."""
    found = present(df, required)
    return df.dropna(subset=found) if found else df


def _orderable(df: DataFrame, columns: Sequence[str]) -> list:
    """Sort expressions over the columns; maps compare by their sorted JSON text."""
    out = []
    for name in columns:
        data_type = df.schema[name].dataType
        column = F.col(name)
        if isinstance(data_type, T.MapType):
            column = F.to_json(F.array_sort(F.map_entries(column)))
        out.append(column.asc_nulls_first())
    return out


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row per key, always the same one: earliest ingested, then by all columns.

    ``row_number() = 1`` lets Spark keep only the best row per key in every map
    task before the shuffle, so a key with very many copies stays cheap.
    """
    keys = present(df, subset or ["event_id"])
    if not keys:
        return df.dropDuplicates()
    first = present(df, ["ingestion_timestamp", "event_timestamp"])
    rest = [c for c in df.columns if c not in keys and c not in first]
    order = _orderable(df, first + rest)
    if not order:
        return df.dropDuplicates(list(keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def normalize_words(df: DataFrame, columns: Sequence[str] = ("event_type", "status")) -> DataFrame:
    """Lower-case, trimmed types and statuses: every later filter relies on it."""
    found = present(df, columns)
    return df.withColumns({c: lower_trim(c) for c in found}) if found else df


def clean(df: DataFrame) -> DataFrame:
    return (
        df.transform(normalize_columns)
        .transform(normalize_words)
        .transform(cast_timestamp_columns)
        .transform(remove_invalid_events)
        .transform(drop_duplicates)
    )


def normalize_events(df: DataFrame) -> DataFrame:
    """Both times as timestamps, the event date, and a lower-case type."""
    event_ts = F.try_to_timestamp(F.col("event_timestamp"))
    return df.withColumns(
        {
            "event_timestamp": event_ts,
            "ingestion_timestamp": F.try_to_timestamp(F.col("ingestion_timestamp")),
            "event_date": F.to_date(event_ts),
            "event_type": lower_trim("event_type"),
        }
    )


# ---- record-level steps on any event frame ------------------------------
def filter_by_event_type(df: DataFrame, event_type: str) -> DataFrame:
    if not event_type.strip():
        raise ValueError("event_type must not be blank")
    return df.filter(F.col("event_type") == event_type)


def filter_valid_events(df: DataFrame) -> DataFrame:
    """Rows with a non-empty event_id."""
    return df.filter(F.col("event_id").isNotNull() & (F.col("event_id") != ""))


def map_normalize(df: DataFrame) -> DataFrame:
    return df.withColumns({"event_id": F.trim("event_id"), "event_type": lower_trim("event_type")})


def distinct_events(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["event_id"]).transform(drop_duplicates)


def key_by_customer(df: DataFrame) -> DataFrame:
    """Rows that have a customer; grouping or repartitioning then uses the column."""
    return df.filter(F.col("customer_id").isNotNull())


def valid_records(df: DataFrame, event_type: str | None = None) -> DataFrame:
    """Valid, normalised, optionally of one type, one row per event."""
    out = df.transform(filter_valid_events).transform(map_normalize)
    if event_type is not None:
        out = filter_by_event_type(out, event_type)
    return distinct_events(out)


def map_values(df: DataFrame, column: str, mapper) -> DataFrame:
    """Replace a column by ``mapper(column)``, a Column expression."""
    return df.withColumn(column, mapper(F.col(column)))


def enrich_metadata(df: DataFrame, given: dict[str, str] | None = None) -> DataFrame:
    """``metadata`` with the given pairs, which win, and the time of processing, which does not."""
    pairs = [F.lit(x) for pair in (given or {}).items() for x in pair]
    extra = F.create_map(*pairs).cast("map<string,string>")
    stamp = F.create_map(F.lit("processed_at"), F.current_timestamp().cast("string"))
    own = F.col("metadata") if "metadata" in df.columns else F.lit(None).cast("map<string,string>")
    return df.withColumn("metadata", merge_maps(stamp, merge_maps(own, extra)))


def event_value(unit_price: str = "unit_price", quantity: str = "quantity") -> Column:
    """Price times quantity to cents; 0 where either is missing."""
    value = F.round(F.col(unit_price) * F.col(quantity), 2)
    return F.coalesce(value, F.lit(0)).cast("decimal(18,2)")


def normalize_stream_event(df: DataFrame) -> DataFrame:
    """Trim ids, lower-case type and status, and drop rows without customer or type."""
    ids = present(
        df, ["event_id", "customer_id", "session_id", "product_id", "order_id", "cart_id", "delivery_id"]
    )
    changes = {c: F.trim(F.col(c)) for c in ids}
    changes |= {c: lower_trim(c) for c in present(df, ["event_type", "status"])}
    return df.withColumns(changes).filter(filled("customer_id") & filled("event_type"))
