"""Loading frames into catalog tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.basics import require
from .files import gather_by_partition


def qualified(table: str, database: str | None = None) -> str:
    if not table.strip():
        raise ValueError("table name must not be blank")
    return f"{database}.{table}" if database else table


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")


def table_exists(spark: SparkSession, table: str, database: str | None = None) -> bool:
    return spark.catalog.tableExists(qualified(table, database))


def drop_table(spark: SparkSession, table: str, database: str | None = None, purge: bool = False) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {qualified(table, database)}{' PURGE' if purge else ''}")


def load(
    df: DataFrame,
    table: str,
    mode: str = "append",
    fmt: str = "parquet",
    partition_by: Sequence[str] | None = None,
    database: str | None = None,
    path: str | None = None,
) -> None:
    if database:
        ensure_database(df.sparkSession, database)
    columns = list(partition_by or [])
    writer = gather_by_partition(df, columns).write.mode(mode).format(fmt)
    if columns:
        writer = writer.partitionBy(*columns)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(qualified(table, database))


def load_partitioned(
    df: DataFrame,
    table: str,
    partition_column: str = "event_date",
    mode: str = "append",
    database: str | None = None,
    path: str | None = None,
) -> None:
    require(df, partition_column)
    load(df, table, mode, partition_by=[partition_column], database=database, path=path)


def load_overwrite(
    df: DataFrame,
    table: str,
    partition_by: Sequence[str] | None = None,
    database: str | None = None,
    path: str | None = None,
) -> None:
    load(df, table, "overwrite", partition_by=partition_by, database=database, path=path)


def insert_sql(df: DataFrame, table: str, database: str | None = None) -> None:
    """INSERT INTO an existing table, columns matched by name."""
    spark = df.sparkSession
    name = qualified(table, database)
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table {name} does not exist")
    columns = ", ".join(df.columns)
    spark.sql(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {{frame}}", frame=df)


def overwrite_partitions(df: DataFrame, table: str, database: str | None = None) -> None:
    """INSERT OVERWRITE of exactly the partitions that occur in the frame."""
    spark = df.sparkSession
    name = qualified(table, database)
    columns = spark.table(name).columns
    rows = gather_by_partition(df.select(*columns), columns[-1:])
    # ``insertInto`` knows no option for this. Sessions of :func:`build_session` have it on for
    # good, so nothing is switched there and loads at the same time do not disturb each other.
    mode = "spark.sql.sources.partitionOverwriteMode"
    previous = spark.conf.get(mode)
    if previous.lower() != "dynamic":
        spark.conf.set(mode, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(name)
    finally:
        if previous.lower() != "dynamic":
            spark.conf.set(mode, previous)
