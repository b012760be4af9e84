"""The batch run: raw JSON to clean, typed, curated and mart tables.

Each layer is written once and read back by the next step. A written Parquet
layer is pruned by column and partition, survives lost executors, and needs no
cache of the whole input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.basics import MONEY, PRICE, count_when
from ..operators import carts, clicks, curate, deliveries, features, refine, sales
from ..operators.aggregates import daily
from ..schemas import EVENT_TYPES
from ..session import FREE_SHUFFLES, settings, stored_bytes
from ..sinks import catalog, files
from ..sources import readers

TYPE_TRANSFORMS = {
    "click": clicks.transform,
    "cart": carts.transform,
    "sales": sales.transform,
    "delivery": deliveries.transform,
}

MARTS = {
    "events": daily.aggregate_events_by_day,
    "sales": daily.aggregate_sales_by_day,
    "clicks": daily.aggregate_clicks_by_day,
    "carts": daily.aggregate_carts_by_day,
    "deliveries": daily.aggregate_deliveries_by_day,
}

#: Stored bytes of a curated layer whose features are built at a time, and the most parts; each part reads the layer once.
PART_BYTES, MOST_PARTS = 512 * 2**20, 8

# --- fixed values: catalog table per processed frame ---
TABLE_OF = {
    "sales": "sales_events",
    "click": "click_events",
    "cart": "cart_events",
    "delivery": "delivery_events",
    "curated": "daily_sales_summary",
}
# --- end of fixed values ---


def process_events(df: DataFrame) -> dict[str, DataFrame]:
    """Normalised events, their clean copy and the four typed branches, all lazy."""
    normalized = refine.normalize_events(df)
    clean = normalized.withColumns(
        {
            "quantity": F.col("quantity").try_cast("int"),
            "unit_price": F.col("unit_price").try_cast(PRICE),
            "total_amount": F.col("total_amount").try_cast(MONEY),
        }
    )
    branches = {name: step(normalized) for name, step in TYPE_TRANSFORMS.items()}
    return {"normalized": normalized, "clean": clean, **branches}


def branch_counts(df: DataFrame) -> DataFrame:
    """Total and per-type row counts in one pass."""
    kind = F.col("event_type")
    return refine.normalize_events(df).agg(
        F.count(F.lit(1)).alias("total_events"),
        *[count_when(kind == t).alias(f"{t}_events") for t in EVENT_TYPES],
    )


def observed(df: DataFrame, name: str = "events") -> tuple[DataFrame, Observation]:
    """Counts collected while the frame is written, without a job of their own."""
    observation = Observation(name)
    kind = F.col("event_type")
    return (
        df.observe(
            observation,
            F.count(F.lit(1)).alias("total_events"),
            *[count_when(kind == t).alias(f"{t}_events") for t in EVENT_TYPES],
        ),
        observation,
    )


def create_curated(processed: dict[str, DataFrame], ordered: bool = True) -> DataFrame:
    return daily.daily_sales_summary(processed["sales"], ordered)


def register_tables(
    spark: SparkSession, frames: dict[str, DataFrame], database: str, root: str
) -> None:
    """Overwrite the Parquet datasets and (re)create their catalog tables."""
    catalog.ensure_database(spark, database)
    for name, df in frames.items():
        table = TABLE_OF[name]
        catalog.drop_table(spark, table, database)
        catalog.load_overwrite(df, table, None, database, path=f"{root}/{name}")


def run_batch(
    spark: SparkSession, input_path: str, output_path: str, database: str | None = None
) -> dict[str, int]:
    """JSON in, clean layer by date, typed branches and daily summary out; returns counts."""
    processed = process_events(readers.read_json(spark, input_path))
    clean_path = f"{output_path}/clean"
    clean, observation = observed(processed["clean"])
    files.write_parquet(clean, clean_path, partition_by=["event_date"])
    counts = dict(observation.get)  # from the write itself: the input is read once
    if not counts["total_events"]:
        raise RuntimeError("no event was found in the input")

    stored = readers.read_parquet(spark, clean_path)
    frames = {name: step(stored) for name, step in TYPE_TRANSFORMS.items()}
    frames["curated"] = create_curated(frames, ordered=False)
    if database:
        register_tables(spark, frames, database, output_path)
    else:
        for name, df in frames.items():
            files.write_parquet(df, f"{output_path}/{name}")
    return counts


def raw_to_clean(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    partition_by: Sequence[str] | None = None,
    fmt: str = "json",
) -> DataFrame:
    clean = refine.clean(readers.read_raw(spark, input_path, fmt))
    files.write_clean(clean, output_path, partition_by)
    return readers.read_clean(spark, output_path)


def clean_to_curated(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    partition_by: Sequence[str] | None = None,
) -> DataFrame:
    files.write_curated(curate.curate(readers.read_clean(spark, input_path)), output_path, partition_by)
    return readers.read_curated(spark, output_path)


def daily_marts(spark: SparkSession, input_path: str, output_path: str) -> dict[str, DataFrame]:
    """Five marts, each in its own folder by date. Every mart scans only its columns."""
    curated = readers.read_curated(spark, input_path)
    stored = {}
    for name, build in MARTS.items():
        mart, path = build(curated, ordered=False), f"{output_path}/{name}"
        files.write_mart(mart, path)
        # with its schema, so that a mart without rows can be read as well
        stored[name] = readers.read_layer(spark, path, schema=mart.schema)
    return stored


def curated_to_features(spark: SparkSession, input_path: str, output_path: str) -> DataFrame:
    """Features by month. Rows are brought together before they get their feature columns, which need not travel.

    A larger layer is taken in parts of whole months, one after the other, and the shuffle files of a part go with it.
    """
    curated, month = readers.read_curated(spark, input_path), ("event_year", "event_month")
    if "event_timestamp" in curated.columns:
        curated = curated.withColumns({"event_year": F.year("event_timestamp"), "event_month": F.month("event_timestamp")})
    columns = files.existing_partitions(curated, month)
    parts = min(MOST_PARTS, -(-stored_bytes(spark, input_path) // PART_BYTES)) if columns else 1
    with settings(spark, FREE_SHUFFLES):
        for part in range(max(1, parts)):
            mine = curated if parts <= 1 else curated.filter(F.pmod(F.xxhash64(*columns), F.lit(parts)) == part)
            built = features.build_features(files.gather_by_partition(mine, columns))
            files.write_features(built, output_path, month, gather=False, mode="append" if part else "overwrite")
    return readers.read_parquet(spark, output_path)


# ---- SQL passthrough -----------------------------------------------------
def register_temp_view(df: DataFrame, name: str) -> None:
    if not name.strip():
        raise ValueError("view name must not be blank")
    df.createOrReplaceTempView(name)


def execute_sql(spark: SparkSession, query: str) -> DataFrame:
    if not query.strip():
        raise ValueError("query must not be blank")
    return spark.sql(query)


def run_sql_list(spark: SparkSession, queries: Sequence[str]) -> list[DataFrame]:
    return [execute_sql(spark, q) for q in queries]
