"""Facts and dimensions stored for joins without a shuffle.

Tables that are joined on one key are stored in the same number of buckets of that key, sorted inside. A join
or a group-by on the key then reads bucket by bucket, with no Exchange above the scans, as often as it is asked
for; the one shuffle is paid when the table is written.

A bucket cannot be split, so keys that hold a large share of the rows, and null keys, are kept beside the buckets
in a plain table. Both sides of a layout share the set of these keys; their join is salted and its rows
are added to the others. Which keys are kept apart never changes the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import HeavyKeys, balanced_join
from ..sinks.catalog import qualified

HEAVY = "_heavy"
#: Rows of the larger table that one bucket holds; a task sorts and joins a bucket.
BUCKET_ROWS = 500_000
#: Null keys never meet in an equi-join, and one bucket would hold all of them.
NULLS_APART = HeavyKeys((), True)


@dataclass(frozen=True)
class Layout:
    """The key of the joins, the number of buckets, and the keys kept beside them."""

    key: str
    buckets: int
    heavy: HeavyKeys = NULLS_APART

    def apart(self) -> Column:
        column = F.col(self.key)
        listed = column.isin(*self.heavy.values) if self.heavy.values else F.lit(False)
        return F.coalesce(listed, F.lit(False)) | column.isNull()


def buckets_for(rows: int, least: int = 8) -> int:
    """Buckets for tables of so many rows, so that a bucket stays small however many they are."""
    return max(least, -(-rows // BUCKET_ROWS))


def store(df: DataFrame, layout: Layout, table: str, database: str | None = None, path: str | None = None) -> None:
    """Write both parts of a table; ``path`` is the folder for external tables.

    The rows are dealt by the function that also numbers the buckets, so a bucket is one file.
    """
    for name, rows in ((table, df.filter(~layout.apart())), (table + HEAVY, df.filter(layout.apart()))):
        if name == table:
            rows = rows.repartition(layout.buckets, layout.key)
            writer = rows.write.bucketBy(layout.buckets, layout.key).sortBy(layout.key)
        else:
            writer = rows.write
        if path:
            writer = writer.option("path", f"{path}/{name}")
        writer.format("parquet").mode("overwrite").saveAsTable(qualified(name, database))


def drop(spark: SparkSession, table: str, database: str | None = None) -> None:
    for name in (table, table + HEAVY):
        spark.sql(f"DROP TABLE IF EXISTS {qualified(name, database)}")


def rows(spark: SparkSession, table: str, database: str | None = None) -> DataFrame:
    """The whole table; for what does not need the key's buckets."""
    parts = [spark.table(qualified(n, database)) for n in (table, table + HEAVY)]
    return parts[0].unionByName(parts[1])


def join(
    spark: SparkSession, left: str, right: str, layout: Layout, how: str = "inner", database: str | None = None
) -> DataFrame:
    """``left JOIN right USING (key)``: bucket to bucket, and salted for the keys kept apart."""
    of = lambda name: spark.table(qualified(name, database))
    ordinary = of(left).join(of(right), layout.key, how)
    special = balanced_join(of(left + HEAVY), of(right + HEAVY), layout.key, how, heavy=layout.heavy)
    return ordinary.unionByName(special)


def per_key(
    spark: SparkSession, table: str, layout: Layout, measures: list[Column], database: str | None = None
) -> DataFrame:
    """Measures per key: within the buckets without a shuffle, by partial sums for the keys kept apart."""
    parts = [spark.table(qualified(n, database)).groupBy(layout.key).agg(*measures) for n in (table, table + HEAVY)]
    return parts[0].unionByName(parts[1])
