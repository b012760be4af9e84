"""What the four per-type transforms share: filters, calendar columns, summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import flag, lower_trim, present
from ..schemas import EVENT_COLUMNS, FIELDS_BY_TYPE

WEEKEND = (1, 7)

#: (source column or None, function that builds the aggregate). Built late, so
#: that measures can be listed at module level before a session exists.
Measure = tuple[str | None, Callable[[], Column]]


def only_type(df: DataFrame, event_type: str) -> DataFrame:
    return df.filter(F.col("event_type") == event_type)


def typed_view(df: DataFrame, event_type: str) -> DataFrame:
    """Rows of one type without the columns that belong to other types.

    Columns outside the unified event row (derived ones) are kept.
    """
    foreign = set(EVENT_COLUMNS) - set(FIELDS_BY_TYPE[event_type])
    return only_type(df, event_type).select(*[c for c in df.columns if c not in foreign])


def normalize(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, lower_trim(column)) if column in df.columns else df


def label(column: str, mapping: dict[str, str], default: str) -> Column:
    """Map a column's values to labels, anything else to the default."""
    out = None
    for value, name in mapping.items():
        test = F.col(column) == value
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def one_hot(df: DataFrame, column: str, prefix: str, values: Sequence[str]) -> DataFrame:
    if column not in df.columns:
        return df
    return df.withColumns({f"{prefix}{v}": flag(F.col(column) == v) for v in values})


def calendar(df: DataFrame, prefix: str, parts: Sequence[str]) -> DataFrame:
    """Calendar columns of the event time, named with the prefix of the type."""
    if "event_timestamp" not in df.columns:
        return df
    ts = F.col("event_timestamp")
    every = {
        "hour": F.hour(ts),
        "day_of_week": F.dayofweek(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "is_weekend": flag(F.dayofweek(ts).isin(*WEEKEND)),
    }
    return df.withColumns({f"{prefix}_{p}": every[p] for p in parts})


def grouped(
    df: DataFrame,
    by: Sequence[str],
    measures: Sequence[Measure],
) -> DataFrame:
    """Group by the columns that are present; a measure needs its source column.

    Aggregation is partial per task before the shuffle, so one very frequent
    group value costs one row per task, not its whole group in one place.
    """
    keys = present(df, by)
    if by and not keys:
        raise ValueError(f"none of the group columns {list(by)} is present")
    chosen = [make() for source, make in measures if source is None or source in df.columns]
    return df.groupBy(*keys).agg(*chosen) if keys else df.agg(*chosen)


def rows(alias: str) -> Measure:
    return None, lambda: F.count(F.lit(1)).alias(alias)


def distinct(column: str, alias: str) -> Measure:
    return column, lambda: F.count_distinct(F.col(column)).alias(alias)


def total(column: str, alias: str) -> Measure:
    return column, lambda: F.sum(F.col(column).cast("long")).alias(alias)


def measure(column: str, alias: str, build: Callable[[str], Column]) -> Measure:
    """``build(column)`` under an alias, e.g. ``measure("total_amount", "sales", sum_money)``."""
    return column, lambda: build(column).alias(alias)
