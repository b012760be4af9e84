"""File sinks for batch frames."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import ISO_FORMAT, dump_row
from ..functions.timestamps import sink_partitions
from ..session import settings

SINK_PARTITIONS = ("ano", "mes", "dia", "hora")
#: Columns with a handful of values: a task writes few files for them, so their rows stay where they are.
FEW_VALUES = ("event_type", "status")
#: Files of such values that a task holds open at once; it sorts its rows only beyond that.
OPEN_FILES = 8


def _target(path: str | None) -> str:
    if path is None or not path.strip():
        raise ValueError("path must not be blank")
    return path


def existing_partitions(df: DataFrame, partition_by: Sequence[str] | None) -> list[str]:
    """Partition columns that are named and present; blank names are dropped."""
    names = [c.strip() for c in partition_by or [] if c.strip()]
    return [c for c in names if c in df.columns]


def gather_by_partition(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bring the rows of a partition value together before a partitioned write.

    Without this each of thousands of tasks would write a small file into every
    date. The rebalance is adaptive: tiny values share a task and a hot value is
    split over several, so no date is written by one task alone. Columns of a
    few values alone are left as they are: their rows need not move.
    """
    return df.hint("rebalance", *[F.col(c) for c in columns]) if set(columns) - set(FEW_VALUES) else df


def open_files(spark, number: int):
    """A write inside keeps so many files open per task, so that rows need no sort by partition."""
    return settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(number)})


def write_layer(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] | None = None,
    gather: bool = True,
) -> None:
    """One layer in its format; only partition columns that exist are used.

    ``gather=False`` is for rows that were brought together before.
    """
    columns = existing_partitions(df, partition_by)
    writer = (gather_by_partition(df, columns) if gather else df).write.mode(mode).format(fmt)
    if columns:
        writer = writer.partitionBy(*columns)
    few = columns and set(columns) <= set(FEW_VALUES)
    with open_files(df.sparkSession, OPEN_FILES) if few else nullcontext():
        writer.save(_target(path))


def write_parquet(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None
) -> None:
    columns = [c.strip() for c in partition_by or [] if c.strip()]
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown partition columns: {unknown}")
    write_layer(df, path, "parquet", mode, columns)


def write_clean(df: DataFrame, path: str, partition_by=None, fmt="parquet", mode="overwrite") -> None:
    write_layer(df, path, fmt, mode, partition_by)


def write_curated(df: DataFrame, path: str, partition_by=None, fmt="parquet", mode="overwrite") -> None:
    write_layer(df, path, fmt, mode, partition_by)


def write_mart(df: DataFrame, path: str, partition_by=("event_date",), fmt="parquet", mode="overwrite") -> None:
    write_layer(df, path, fmt, mode, partition_by)


def write_features(
    df: DataFrame, path: str, partition_by=("event_year", "event_month"), fmt="parquet", mode="overwrite", gather=True
) -> None:
    write_layer(df, path, fmt, mode, partition_by, gather)


def write_jsonl(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partition_by: Sequence[str] | None = None,
) -> None:
    """One JSON object per line, times in ISO form with their microseconds."""
    columns = existing_partitions(df, partition_by)
    writer = gather_by_partition(df, columns).write.mode(mode)
    if columns:
        writer = writer.partitionBy(*columns)
    writer.option("ignoreNullFields", "false").option("timestampFormat", ISO_FORMAT).json(_target(path))


def archive_rows(df: DataFrame, moment: Column | str) -> DataFrame:
    """Compact JSON text plus the year/month/day/hour folder it belongs to."""
    parts = sink_partitions(moment)
    return df.select(dump_row(df).alias("value"), *[parts[p].alias(p) for p in SINK_PARTITIONS])


def write_archive(df: DataFrame, path: str, moment: Column | str, mode: str = "append") -> None:
    """JSONL files under ``ano=/mes=/dia=/hora=`` of the given time; never overwrites a file."""
    rows = gather_by_partition(archive_rows(df, moment), SINK_PARTITIONS)
    rows.write.mode(mode).partitionBy(*SINK_PARTITIONS).text(_target(path))


def write_event_archive(events: DataFrame, path: str) -> None:
    write_archive(events, path, "event_timestamp")


def write_alert_archive(alerts: DataFrame, path: str) -> None:
    write_archive(alerts, path, "event_timestamp")


def write_window_archive(windows: DataFrame, path: str) -> None:
    write_archive(windows, path, "window_start")
