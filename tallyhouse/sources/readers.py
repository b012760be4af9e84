"""Batch scans. All take an explicit schema, so no inference pass is made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.jsontext import parse_events, typed
from ..schemas import EVENT


def _path(path: str | None) -> str:
    if path is None or not path.strip():
        raise ValueError("path must not be blank")
    return path


def read_json(
    spark: SparkSession, path: str, schema: T.StructType = EVENT, mode: str = "PERMISSIVE"
) -> DataFrame:
    """All ``*.json`` files below a folder, one object per line."""
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .option("mode", mode)
        .json(_path(path))
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_path(path))


def read_layer(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """One layer (raw, clean or curated) in its configured format.

    Text formats need a schema; EVENT is used when none is given.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt.lower() in ("json", "csv"):
        reader = reader.schema(EVENT)
    return reader.load(_path(path))


def read_raw(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_layer(spark, path, fmt)


def read_clean(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_layer(spark, path, fmt)


def read_curated(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_layer(spark, path, fmt)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-blank text lines; any Hadoop file system URI works."""
    line = F.trim(F.col("value"))
    return spark.read.text(_path(path)).filter(F.length(line) > 0).select(line.alias("value"))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines dropped, every other line parsed; a bad line fails the job."""
    lines = read_lines(spark, path)
    return lines.select(
        F.from_json("value", EVENT, {"mode": "FAILFAST"}).alias("event")
    ).select("event.*")


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(readable raw events, unreadable lines for quarantine)."""
    raw = parse_events(read_lines(spark, path))
    good = raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record", "_line")
    bad = raw.filter(F.col("_corrupt_record").isNotNull()).select("_line")
    return good, bad


def read_validated_events(spark: SparkSession, path: str) -> DataFrame:
    """Typed EVENT rows that keep the ingestion contract; the rest is skipped."""
    judged = rules.judge_json(read_lines(spark, path))
    return to_unified(typed(judged.filter(rules.is_valid())))


def numbered_lines(spark: SparkSession, path: str, kept: Callable[[Column], Column] | None = None) -> DataFrame:
    """``file``, ``line_number`` from 1, ``value``: every line, or those that ``kept(value)`` picks.

    No file is read by one task. Each split counts its lines; the counts of a file's splits, a few rows per file,
    are summed in order, and a line's number is the sum before its split plus its place inside it. Blank
    lines are counted as well.
    """
    lines = spark.read.text(_path(path)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),  # grows line by line within a split
        "value",
    )
    splits = lines.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    wanted = lines if kept is None else lines.filter(kept(F.col("value")))
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return wanted.join(before, ["file", "_block"]).select("file", number.alias("line_number"), "value")


def is_bad_json(value: Column) -> Column:
    """A line with text that is not a JSON object."""
    return (F.length(F.trim(value)) > 0) & ~F.coalesce(F.try_parse_json(value).cast("string").startswith("{"), F.lit(False))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_number`` and ``value`` of each line that is no JSON object; the job goes on."""
    return numbered_lines(spark, path, is_bad_json)


def read_jsonl_checked(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """JSONL objects; a bad line is an error that names its file and number. Blank lines are left out."""
    bad = bad_lines(spark, path)
    first = bad.orderBy("file", "line_number").limit(1).collect()  # one row at most
    if first:
        file, number, text = first[0]
        raise ValueError(f"{file}, line {number}: no JSON object: {text[:200]}")
    parsed = read_lines(spark, path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))
    return parsed.select("row.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """JSONL objects; a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(_path(path))


def count_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).agg(F.count(F.lit(1)).alias("record_count"))


def count_events(spark: SparkSession, path: str) -> DataFrame:
    return read_validated_events(spark, path).agg(F.count(F.lit(1)).alias("event_count"))


def to_unified(df: DataFrame) -> DataFrame:
    """Any typed event frame to the unified EVENT row, absent fields null."""
    names = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENT.fields
        ]
    )


def read_table(spark: SparkSession, table: str, database: str | None = None) -> DataFrame:
    """Catalog table; an absent one is an error that names it."""
    name = f"{database}.{table}" if database else table
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table {name} does not exist")
    return spark.table(name)
