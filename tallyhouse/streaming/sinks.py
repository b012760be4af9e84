"""Sinks of streaming queries. All are replay-safe: the batch id names what a batch wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.jsontext import ISO_FORMAT, dump_row
from ..functions.rowkeys import window_row
from ..operators import alerts as A
from ..schemas import struct
from ..sinks.files import SINK_PARTITIONS, archive_rows
from ..sinks.keyed import KeyedTable
from ..sinks.rolled import RolledArchive

# --- fixed values ---
WINDOW_TYPE = "WINDOW_AGGREGATION"
WINDOW_SEVERITY = "INFO"
ALERT_ROW = struct(
    "row_key STRING, alert_id STRING, alert_type STRING, severity STRING, message STRING, "
    "event_type STRING, customer_id STRING, product_id STRING, detected_at STRING, "
    "event_timestamp STRING, metrics STRING"
)
# --- end of fixed values ---

#: Micro-batches between two compactions of a keyed table.
COMPACT_EVERY = 1000
#: Codec of the JSONL archives; text readers open the files as they are, ``none`` leaves the lines plain.
ARCHIVE_COMPRESSION = "gzip"
#: Seconds for which readers may still use versions that a compaction has replaced.
GRACE_SECONDS = 6 * 3600


def alert_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, ALERT_ROW)


def window_rows(windows: DataFrame) -> DataFrame:
    """Window results as rows of the alert table, keyed by window, type and owner."""
    key = window_row("window_start", "event_type", "key")
    return windows.select(
        key.alias("row_key"),
        key.alias("alert_id"),
        F.lit(WINDOW_TYPE).alias("alert_type"),
        F.lit(WINDOW_SEVERITY).alias("severity"),
        "event_type",
        F.date_format("window_end", ISO_FORMAT).alias("event_timestamp"),
        dump_row(windows).alias("metrics"),
    )


def newest_first(rows: DataFrame) -> list[Column]:
    """Order in which the first of several rows of a key wins: newest, then by content."""
    whole = F.xxhash64(*[F.col(c) for c in rows.columns])
    return [F.col("event_timestamp").desc_nulls_last(), whole.asc()]


def write_alerts(alerts: DataFrame, table: KeyedTable, version: int, run: str = "batch") -> None:
    rows = A.serialize(alerts)
    table.upsert(rows, version, newest_first(rows), run)


def write_windows(windows: DataFrame, table: KeyedTable, version: int, run: str = "batch") -> None:
    rows = window_rows(windows)
    table.upsert(rows, version, newest_first(rows), run)


def run_of(batch: DataFrame, default: str = "batch") -> str:
    """Id of the streaming query that a micro-batch belongs to; it lives in the checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or default


def keyed_writer(
    table: KeyedTable,
    to_rows: Callable[[DataFrame], DataFrame],
    compact_every: int = COMPACT_EVERY,
    grace_seconds: float = GRACE_SECONDS,
    unique: bool = False,
):
    """``foreachBatch`` body: one versioned write per micro-batch, folded now and then.

    A table then holds the versions of one fold and of the grace time, however long the stream runs.
    ``unique`` is for rows of which no two in a batch have one key, such as windows per owner: they are not ranked, and stay
    in their tasks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, run = to_rows(batch), run_of(batch)
        table.upsert(rows, batch_id, () if unique else newest_first(rows), run)
        if compact_every and batch_id and batch_id % compact_every == 0:
            table.compact(batch_id, run)
            table.retire(grace_seconds)

    return write


def start_keyed(
    frame: DataFrame,
    table: KeyedTable,
    to_rows: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    output_mode: str = "append",
    unique: bool = False,
    **trigger,
) -> StreamingQuery:
    return (
        frame.writeStream.outputMode(output_mode)
        .foreachBatch(keyed_writer(table, to_rows, unique=unique))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def archive_writer(path: str, moment: Column | str, compression: str = ARCHIVE_COMPRESSION):
    """``foreachBatch`` body: the batch as JSONL by hour, under the names of its run and batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = archive_rows(batch, moment)
        target = f"{path}/run={run_of(batch)}/batch={batch_id}"
        rows.write.mode("overwrite").option("compression", compression).partitionBy(*SINK_PARTITIONS).text(target)

    return write


def start_both(frame: DataFrame, first, second, checkpoint: str, **trigger) -> StreamingQuery:
    """One query whose micro-batches go to two writers; the batch is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.DISK_ONLY)
        try:
            first(batch, batch_id)
            second(batch, batch_id)
        finally:
            batch.unpersist()

    return (
        frame.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_archive(
    frame: DataFrame,
    path: str,
    moment: Column | str,
    checkpoint: str,
    compression: str = ARCHIVE_COMPRESSION,
    **trigger,
) -> StreamingQuery:
    """JSONL archive by year, month, day and hour of the given time."""
    return (
        archive_rows(frame, moment)
        .writeStream.format("text")
        .partitionBy(*SINK_PARTITIONS)
        .option("compression", compression)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def start_parquet(frame: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        frame.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_console(frame: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        frame.writeStream.format("console")
        .option("truncate", "false")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def start_rolled(
    frame: DataFrame, archive: RolledArchive, moment: Column | str, checkpoint: str, **trigger
) -> StreamingQuery:
    """JSONL archive by hour whose files are closed at each micro-batch or at the archive's limit."""

    def write(batch: DataFrame, batch_id: int) -> None:
        archive.write(batch, batch_id, run_of(batch))

    return (
        archive_rows(frame, moment)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )
