from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import typed


def with_event_date(df: DataFrame) -> DataFrame:
    if "event_date" in df.columns:
        return df
    if "event_timestamp" not in df.columns:
        raise ValueError("event_date or event_timestamp is needed")
    return df.withColumn("event_date", F.to_date("event_timestamp"))


def summarise(
    df: DataFrame,
    by: Sequence[str],
    measures: Sequence[typed.Measure],
    order: Sequence[str | Column] = (),
    *,
    ordered: bool = True,
    drop_null: str | None = None,
) -> DataFrame:
    """Grouped measures; the group columns must exist, null keys may be dropped."""
    missing = [c for c in by if c not in df.columns]
    if missing:
        raise ValueError(f"missing group columns: {missing}")
    if drop_null:
        df = df.filter(F.col(drop_null).isNotNull())
    out = typed.grouped(df, by, measures)
    return out.orderBy(*order) if ordered and order else out
