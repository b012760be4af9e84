"""Continuous file sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.basics import filled
from ..functions.jsontext import typed
from ..schemas import EVENT, EVENT_COLUMNS, EVENT_TYPES
from ..sources.readers import to_unified


def read_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    schema: T.StructType = EVENT,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """New files of a folder. A cap on files per trigger bounds the work of one batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def read_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Trimmed non-blank lines of new text files; any Hadoop file system URI works."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    line = F.trim(F.col("value"))
    return reader.load(path).filter(F.length(line) > 0).select(line.alias("value"))


def parse(lines: DataFrame) -> DataFrame:
    """JSON lines to typed events; an unreadable line has only nulls and fails ``valid``.

    ``inline`` keeps later filters above the parser, so each line is parsed once.
    """
    return lines.select(F.inline(F.array(F.from_json("value", EVENT))))


def parse_kept(lines: DataFrame, fields: Sequence[str] = EVENT_COLUMNS) -> DataFrame:
    """Like :func:`parse`, with the line itself beside the event. Only the ``fields`` of the event are made from a line."""
    parsed = F.from_json("value", T.StructType([f for f in EVENT.fields if f.name in fields]))
    return lines.select(F.inline(F.array(F.struct(parsed.alias("event"), F.col("value").alias("line"))))).select(
        "event.*", "line"
    )


def lacks() -> Column:
    """Names of the fields without which an event cannot be used; empty for a usable one.

    The test is the one after normalisation: a blank id counts as missing, and so does a type that
    is blank or not in the contract.
    """
    usable = {
        "event_id": filled("event_id"),
        "event_type": F.lower(F.trim("event_type")).isin(*EVENT_TYPES),
        "customer_id": filled("customer_id"),
        "event_timestamp": F.col("event_timestamp").isNotNull(),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in usable.items()]))


def incomplete(events: DataFrame) -> DataFrame:
    """Rows that :func:`valid` leaves out, with the names of the fields they lack."""
    return events.select("line", "event_id", lacks().alias("missing")).filter(F.size("missing") > 0)


def with_odd_lines(events: DataFrame) -> DataFrame:
    """Events of :func:`parse_kept` that keep their line only where it cannot be used."""
    return events.withColumn("line", F.when(F.size(lacks()) > 0, F.col("line")))


def valid(events: DataFrame) -> DataFrame:
    """Rows with an id, a type of the contract, an event time and a customer."""
    return events.filter(
        filled("event_id")
        & F.lower(F.trim("event_type")).isin(*EVENT_TYPES)
        & F.col("event_timestamp").isNotNull()
        & filled("customer_id")
    )


def read_validated(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(typed events that keep the contract, quarantined rows with their reasons)."""
    judged = rules.judge_json(read_lines(spark, path, **options))
    good = to_unified(typed(judged.filter(rules.is_valid())))
    return good, judged.filter(~rules.is_valid())


def stamp_ingestion(events: DataFrame) -> DataFrame:
    """Fill the ingestion time of rows that come without one."""
    now = F.coalesce(F.col("ingestion_timestamp"), F.current_timestamp())
    return events.withColumn("ingestion_timestamp", now)
