"""Clean to curated: dates, order totals, lateness, the curated column set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import MONEY, present
from ..functions.predicates import event_delay_seconds, is_late_event
from ..schemas import CURATED_COLUMNS


def add_event_date(df: DataFrame) -> DataFrame:
    if "event_timestamp" not in df.columns:
        return df
    return df.withColumn("event_date", F.to_date("event_timestamp"))


def add_event_hour(df: DataFrame) -> DataFrame:
    if "event_timestamp" not in df.columns:
        return df
    return df.withColumn("event_hour", F.hour("event_timestamp"))


def add_order_metrics(df: DataFrame) -> DataFrame:
    """Total in cents; from quantity and price only where the column is absent."""
    if "total_amount" in df.columns:
        total = F.col("total_amount")
    elif {"quantity", "unit_price"} <= set(df.columns):
        total = F.col("quantity") * F.col("unit_price")
    else:
        return df
    return df.withColumn("total_amount", F.round(total.try_cast("decimal(20,6)"), 2).try_cast(MONEY))


def add_processing_metadata(df: DataFrame) -> DataFrame:
    if "event_timestamp" not in df.columns:
        return df
    return df.withColumns(
        {
            "event_year": F.year("event_timestamp"),
            "event_month": F.month("event_timestamp"),
            "event_day": F.dayofmonth("event_timestamp"),
        }
    )


def add_lateness(df: DataFrame) -> DataFrame:
    """Delay between event and ingestion, as the curated table expects it."""
    if not {"event_timestamp", "ingestion_timestamp"} <= set(df.columns):
        return df
    return df.withColumns(
        {"event_delay_seconds": event_delay_seconds(), "is_late_event": is_late_event()}
    )


def select_curated_columns(df: DataFrame) -> DataFrame:
    found = present(df, CURATED_COLUMNS)
    return df.select(*found) if found else df


def curate(df: DataFrame) -> DataFrame:
    return (
        df.transform(add_event_date)
        .transform(add_event_hour)
        .transform(add_order_metrics)
        .transform(add_processing_metadata)
        .transform(add_lateness)
        .transform(select_curated_columns)
    )
