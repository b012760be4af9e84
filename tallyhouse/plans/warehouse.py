"""Star schema, staging tables, partitions, backfill and maintenance.

All tables are ``USING parquet`` on Spark's own catalog, so no Hive support is
needed; a metastore, if the session has one, is used as it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DateType, NumericType, TimestampType

from ..sinks.catalog import ensure_database, overwrite_partitions, qualified, table_exists

# --- fixed values: column lists of the warehouse tables ---
DIMENSIONS = {
    "dim_customer": "customer_sk BIGINT, customer_id STRING, name STRING, email STRING, "
    "registration_date TIMESTAMP, segment STRING, metadata MAP<STRING,STRING>",
    "dim_product": "product_sk BIGINT, product_id STRING, name STRING, category_id STRING, "
    "brand STRING, price DECIMAL(18,2), stock_quantity BIGINT, metadata MAP<STRING,STRING>",
    "dim_category": "category_sk BIGINT, category_id STRING, name STRING, description STRING, "
    "parent_category_id STRING, metadata MAP<STRING,STRING>",
    "dim_date": "date_sk INT, calendar_date DATE, year INT, quarter INT, month INT, "
    "month_name STRING, week_of_year INT, day_of_month INT, day_of_week INT, day_name STRING, "
    "is_weekend BOOLEAN, is_month_start BOOLEAN, is_month_end BOOLEAN",
}
FACTS = {
    "fact_sales": "event_id STRING, order_id STRING, customer_id STRING, product_id STRING, "
    "quantity INT, unit_price DECIMAL(18,2), total_amount DECIMAL(18,2), status STRING, "
    "event_timestamp TIMESTAMP, ingestion_timestamp TIMESTAMP, session_id STRING",
    "fact_clicks": "event_id STRING, customer_id STRING, product_id STRING, session_id STRING, "
    "page STRING, action STRING, event_timestamp TIMESTAMP, ingestion_timestamp TIMESTAMP",
    "fact_carts": "event_id STRING, cart_id STRING, customer_id STRING, product_id STRING, "
    "session_id STRING, quantity INT, action STRING, event_timestamp TIMESTAMP, "
    "ingestion_timestamp TIMESTAMP",
    "fact_deliveries": "event_id STRING, order_id STRING, delivery_id STRING, "
    "customer_id STRING, status STRING, carrier STRING, estimated_delivery TIMESTAMP, "
    "actual_delivery TIMESTAMP, event_timestamp TIMESTAMP, ingestion_timestamp TIMESTAMP",
}
_EVENT_FIELDS = (
    "event_id STRING, event_type STRING, event_timestamp TIMESTAMP, "
    "ingestion_timestamp TIMESTAMP, customer_id STRING, session_id STRING, {metadata}"
    "product_id STRING, page STRING, action STRING, cart_id STRING, quantity INT, "
    "order_id STRING, unit_price DECIMAL(18,2), total_amount DECIMAL(18,2), status STRING, "
    "delivery_id STRING, carrier STRING, estimated_delivery TIMESTAMP, actual_delivery TIMESTAMP"
)
_WITH_METADATA = _EVENT_FIELDS.format(metadata="metadata MAP<STRING,STRING>, ")
STAGING = {
    "external_raw_events": _WITH_METADATA,
    "external_clean_events": _WITH_METADATA,
    "external_curated_events": _EVENT_FIELDS.format(metadata="")
    + ", event_year INT, event_month INT, event_day INT, event_hour INT, "
    "event_delay_seconds DOUBLE, is_late_event BOOLEAN",
    "external_streaming_metrics": "event_type STRING, aggregation_key STRING, "
    "window_start TIMESTAMP, window_end TIMESTAMP, event_count BIGINT, metric_value DOUBLE, "
    "processing_timestamp TIMESTAMP",
    "external_streaming_alerts": "alert_id STRING, alert_type STRING, severity STRING, "
    "message STRING, event_id STRING, event_type STRING, alert_timestamp TIMESTAMP, "
    "metadata MAP<STRING,STRING>",
}
STAGING_FOLDERS = {
    "external_raw_events": "raw/events",
    "external_clean_events": "processed/clean",
    "external_curated_events": "processed/curated",
    "external_streaming_metrics": "streaming/metrics",
    "external_streaming_alerts": "streaming/alerts",
}
FACT_SOURCE = {
    "fact_sales": ("order", ("order_id",)),
    "fact_clicks": ("click", ()),
    "fact_carts": ("cart", ()),
    "fact_deliveries": ("delivery", ()),
}
PARTITION_COLUMN = "event_date"
# --- end of fixed values ---


@dataclass(frozen=True)
class Databases:
    core: str = "ecommerce"
    staging: str = "ecommerce_staging"
    analytics: str = "ecommerce_analytics"

    def all(self) -> tuple[str, str, str]:
        return self.core, self.staging, self.analytics


# ---- tables ---------------------------------------------------------------
def split_columns(columns: str) -> dict[str, str]:
    """``a INT, b MAP<X,Y>`` to a name/type dict, commas inside types kept."""
    from pyspark.sql.types import StructType

    return {f.name: f.dataType.simpleString() for f in StructType.fromDDL(columns).fields}


def create_statement(
    name: str,
    columns: dict[str, str] | str,
    partition_columns: Sequence[str] = (),
    location: str | None = None,
    fmt: str = "parquet",
    if_not_exists: bool = True,
) -> str:
    """DDL text. Partition columns belong to the column list, named once."""
    typed = split_columns(columns) if isinstance(columns, str) else dict(columns)
    if not typed:
        raise ValueError("a table needs columns")
    missing = [c for c in partition_columns if c not in typed]
    if missing:
        raise ValueError(f"partition columns without a type: {missing}")
    ordered = [c for c in typed if c not in partition_columns] + list(partition_columns)
    body = ", ".join(f"`{c}` {typed[c]}" for c in ordered)
    parts = f" PARTITIONED BY ({', '.join(partition_columns)})" if partition_columns else ""
    where = f" LOCATION '{location}'" if location else ""
    guard = "IF NOT EXISTS " if if_not_exists else ""
    return f"CREATE TABLE {guard}{name} ({body}) USING {fmt}{parts}{where}"


def create_table(
    spark: SparkSession,
    table: str,
    columns: dict[str, str] | str,
    partition_columns: Sequence[str] = (),
    database: str | None = None,
    fmt: str = "parquet",
    location: str | None = None,
) -> None:
    """Managed table, or external when a location is given."""
    if database:
        ensure_database(spark, database)
    spark.sql(create_statement(qualified(table, database), columns, partition_columns, location, fmt))


def create_external_table(
    spark: SparkSession,
    table: str,
    columns: dict[str, str] | str,
    location: str,
    partition_columns: Sequence[str] = (),
    database: str | None = None,
    fmt: str = "parquet",
) -> None:
    if not location.strip():
        raise ValueError("location must not be blank")
    create_table(spark, table, columns, partition_columns, database, fmt, location)


def describe_table(spark: SparkSession, table: str, database: str | None = None) -> DataFrame:
    """Column names and types, in table order, partition columns last."""
    schema = spark.table(qualified(table, database)).schema
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "position INT, col_name STRING, data_type STRING")


def show_tables(spark: SparkSession, database: str) -> DataFrame:
    listed = spark.sql(f"SHOW TABLES IN {database}")
    return listed.filter(~F.col("isTemporary")).select(F.col("tableName").alias("table_name"))


def _existing(spark: SparkSession, table: str, database: str | None) -> str:
    if not table_exists(spark, table, database):
        raise ValueError(f"table {qualified(table, database)} does not exist")
    return qualified(table, database)


def truncate_table(spark: SparkSession, table: str, database: str | None = None) -> None:
    spark.sql(f"TRUNCATE TABLE {_existing(spark, table, database)}")


def rename_table(spark: SparkSession, table: str, new_name: str, database: str | None = None) -> None:
    old = _existing(spark, table, database)
    spark.sql(f"ALTER TABLE {old} RENAME TO {qualified(new_name, database)}")


def analyze_table(spark: SparkSession, table: str, database: str | None = None) -> None:
    spark.sql(f"ANALYZE TABLE {_existing(spark, table, database)} COMPUTE STATISTICS")


#: Settings under which column statistics decide the order of joins.
COST_BASED = {
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.planStats.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block; plans are made when a result is asked for."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cost_based(spark: SparkSession):
    """Joins of analyzed tables are ordered by estimated rows while this holds."""
    return settings(spark, COST_BASED)


def is_key(column: str) -> bool:
    return column.endswith(("_id", "_sk"))


def analyze_columns(
    spark: SparkSession,
    table: str,
    columns: Sequence[str] | None = None,
    database: str | None = None,
    histograms: Sequence[str] | None = None,
) -> None:
    """Row count and, per column, range, nulls and distinct values; for some also an equal-height histogram.

    Without a list every column of a single value is taken, and of these the numbers, dates and times that are no
    keys get a histogram, for filters by range. Keys get none: a filter on another column leaves a key's histogram as it was,
    and the join estimated from it comes out far too large. One scan, and two for histograms, of the named columns only.
    """
    name = _existing(spark, table, database)
    single = {f.name: f.dataType for f in spark.table(name).schema.fields if isinstance(f.dataType, AtomicType)}
    columns = list(single) if columns is None else list(columns)
    if not columns:
        raise ValueError("no columns to analyze")
    if histograms is None:
        ranged = (NumericType, DateType, TimestampType)
        histograms = [c for c in columns if isinstance(single.get(c), ranged) and not is_key(c)]
    for chosen, values in (
        ([c for c in columns if c not in histograms], {}),
        (list(histograms), {"spark.sql.statistics.histogram.enabled": "true"}),
    ):
        if chosen:
            with settings(spark, values):
                listed = ", ".join(f"`{c}`" for c in chosen)
                spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {listed}")


def column_statistics(
    spark: SparkSession, table: str, columns: Sequence[str], database: str | None = None
) -> DataFrame:
    """What the catalog knows of the columns, as text; null where nothing was gathered."""
    name, wanted = _existing(spark, table, database), ("distinct_count", "num_nulls", "min", "max", "histogram")
    rows = []
    for column in columns:  # catalog entries, one per column
        told = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {name} `{column}`").collect()}
        known = {k: None if told.get(k) in (None, "NULL") else told[k] for k in wanted}
        rows.append((table, column, *[known[k] for k in wanted[:-1]], known["histogram"] is not None))
    return spark.createDataFrame(
        rows, "table_name STRING, column_name STRING, distinct_count STRING, num_nulls STRING, "
        "min STRING, max STRING, has_histogram BOOLEAN")


def create_database(
    spark: SparkSession, database: str, location: str | None = None, if_not_exists: bool = True
) -> None:
    guard = "IF NOT EXISTS " if if_not_exists else ""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE {guard}{database}{where}")


def drop_database(spark: SparkSession, database: str, cascade: bool = False) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {database}{' CASCADE' if cascade else ''}")


# ---- partitions -----------------------------------------------------------
def _spec(spec: dict[str, str]) -> str:
    if not spec:
        raise ValueError("a partition spec must not be empty")
    return ", ".join(f"{k}='{v}'" for k, v in spec.items())


def add_partition(
    spark: SparkSession,
    table: str,
    spec: dict[str, str],
    database: str | None = None,
    location: str | None = None,
) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"ALTER TABLE {qualified(table, database)} ADD IF NOT EXISTS PARTITION ({_spec(spec)}){where}"
    )


def drop_partition(
    spark: SparkSession, table: str, spec: dict[str, str], database: str | None = None
) -> None:
    spark.sql(f"ALTER TABLE {qualified(table, database)} DROP IF EXISTS PARTITION ({_spec(spec)})")


def show_partitions(spark: SparkSession, table: str, database: str | None = None) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {qualified(table, database)}")


def partition_exists(
    spark: SparkSession, table: str, spec: dict[str, str], database: str | None = None
) -> bool:
    """Looks up exactly one partition instead of listing all of them."""
    name = qualified(table, database)
    return not spark.sql(f"SHOW PARTITIONS {name} PARTITION ({_spec(spec)})").isEmpty()


def drop_partition_if_exists(
    spark: SparkSession, table: str, spec: dict[str, str], database: str | None = None
) -> bool:
    found = partition_exists(spark, table, spec, database)
    if found:
        drop_partition(spark, table, spec, database)
    return found


def repair_table(spark: SparkSession, table: str, database: str | None = None) -> None:
    spark.sql(f"MSCK REPAIR TABLE {qualified(table, database)}")


def recover_partitions(spark: SparkSession, table: str, database: str | None = None) -> None:
    spark.catalog.recoverPartitions(qualified(table, database))


def create_range(start, end) -> "F.Column":
    """Every day from start to end inclusive, one row each; a reversed range is an error."""
    first, last = F.to_date(F.lit(start) if isinstance(start, str) else start), F.to_date(
        F.lit(end) if isinstance(end, str) else end
    )
    days = F.sequence(first, last, F.expr("INTERVAL 1 DAY"))
    reversed_range = F.raise_error(F.lit("the end of the range is before its start"))
    return F.explode(F.when(first <= last, days).otherwise(reversed_range.cast("array<date>")))


# ---- star schema ----------------------------------------------------------
def dim_date(span: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Calendar rows for a one-row frame that holds the first and last day."""
    day = F.col("calendar_date")
    out = span.select(create_range(F.col(start), F.col(end)).alias("calendar_date"))
    return out.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_sk"),
        "calendar_date",
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.weekofyear(day).alias("week_of_year"),
        F.dayofmonth(day).alias("day_of_month"),
        F.dayofweek(day).alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.dayofweek(day).isin(1, 7).alias("is_weekend"),
        (F.dayofmonth(day) == 1).alias("is_month_start"),
        (day == F.last_day(day)).alias("is_month_end"),
    )


def date_span(events: DataFrame) -> DataFrame:
    return events.agg(
        F.to_date(F.min("event_timestamp")).alias("start"),
        F.to_date(F.max("event_timestamp")).alias("end"),
    )


def create_databases(spark: SparkSession, names: Databases, root: str | None = None) -> None:
    for database in names.all():
        ensure_database(spark, database, f"{root}/{database}" if root else None)


def create_dimensions(spark: SparkSession, names: Databases) -> None:
    for table, columns in DIMENSIONS.items():
        create_table(spark, table, columns, database=names.core)


def create_facts(spark: SparkSession, names: Databases) -> None:
    for table, columns in FACTS.items():
        create_table(
            spark, table, f"{columns}, {PARTITION_COLUMN} DATE", [PARTITION_COLUMN], names.core
        )


def create_staging(spark: SparkSession, names: Databases, root: str) -> None:
    for table, columns in STAGING.items():
        create_external_table(
            spark,
            table,
            f"{columns}, {PARTITION_COLUMN} DATE",
            f"{root}/{STAGING_FOLDERS[table]}",
            [PARTITION_COLUMN],
            names.staging,
        )


def load_dimension(df: DataFrame, table: str, names: Databases) -> None:
    columns = df.sparkSession.table(qualified(table, names.core)).columns
    df.select(*columns).write.mode("overwrite").insertInto(qualified(table, names.core))


# ---- backfill and maintenance ---------------------------------------------
def fact_rows(curated: DataFrame, table: str) -> DataFrame:
    """Rows of one fact from curated events: lower-case types, keys and times present."""
    event_type, keys = FACT_SOURCE[table]
    rows = curated.filter(F.col("event_type") == event_type).dropna(
        subset=["event_timestamp", *keys]
    )
    typed = split_columns(FACTS[table])
    return rows.select(
        *[
            (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
            for c, t in typed.items()
        ],
        F.to_date("event_timestamp").alias(PARTITION_COLUMN),
    )


def backfill(curated: DataFrame, table: str, names: Databases) -> None:
    """Overwrite the dates that occur in the input, leave all others alone."""
    overwrite_partitions(fact_rows(curated, table), table, names.core)


def backfill_all(curated: DataFrame, names: Databases) -> None:
    for table in FACTS:
        backfill(curated, table, names)


def load_daily_partitions(spark: SparkSession, names: Databases) -> None:
    for table in STAGING:
        repair_table(spark, table, names.staging)
    for table in FACTS:
        repair_table(spark, table, names.core)


#: Columns of the facts that joins and filters of the views go by; their ids of single events tell a plan nothing.
FACT_STATISTICS = ("customer_id", "product_id", "order_id", "status", "carrier", "action", "quantity", "event_timestamp")


def refresh_statistics(spark: SparkSession, names: Databases, columns: bool = False) -> None:
    """Sizes of all tables; with ``columns`` also the column statistics that order joins."""
    for table in (*FACTS, *DIMENSIONS):
        if not columns:
            analyze_table(spark, table, names.core)
            continue
        present = spark.table(qualified(table, names.core)).columns
        chosen = [c for c in FACT_STATISTICS if c in present] if table in FACTS else None
        analyze_columns(spark, table, chosen, names.core)


def probe_views(spark: SparkSession, names: Databases, views: Sequence[str]) -> DataFrame:
    """view and rows of every view: each one is read to its end."""
    counts = [
        spark.table(qualified(v, names.analytics)).agg(F.lit(v).alias("view"), F.count(F.lit(1)).alias("rows"))
        for v in views
    ]
    return reduce(DataFrame.unionByName, counts)
