"""A table addressed by row key, kept as Parquet.

Every write adds the changed rows under its own version folder and never touches
older ones, so its cost follows the batch, not the table. A version is named by
the place of its run among all runs that wrote to the table, the batch within the
run, the kind of write, and the run itself. Writing a version again replaces that
version only: a replayed micro-batch changes nothing, while a new checkpoint,
which counts its batches from 0 again, is a new run and replaces nothing. A read
keeps the newest row per key; the newest is picked inside each task before the
shuffle, and a filter on the key reaches the scan. ``compact`` adds a version with
all current rows; reads then start from it, and ``retire`` removes what it has replaced
for long enough. A base counts from the moment it is complete, so a writer that dies
in between hides nothing.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.basics import present

KEY = "row_key"
VERSION = "version"
DELETED = "deleted"

# --- fixed values: column families per keyed table ---
FAMILIES = {
    "ecommerce_alerts": ("alert", "event", "metric"),
    "ecommerce_streaming_events": ("event", "customer", "commerce", "logistics"),
    "ecommerce_sales_metrics": ("sales", "customer", "product", "time"),
    "ecommerce_delivery_metrics": ("delivery", "order", "carrier", "time"),
}
# --- end of fixed values ---


def definitions_for_creation() -> dict[str, T.StructType]:
    """Schema per keyed table: the key and one text map per column family."""
    cell = T.MapType(T.StringType(), T.StringType())
    return {
        name: T.StructType(
            [T.StructField(KEY, T.StringType(), False)] + [T.StructField(f, cell) for f in families]
        )
        for name, families in FAMILIES.items()
    }


#: Order of the kinds of write within one batch.
_STEPS = {"upsert": 0, "delete": 1, "columns": 2, "base": 9}
_NAME = re.compile(r"(\d{6})-(\d{12})-(\d)-(.+)")


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        if KEY not in schema.fieldNames():
            raise ValueError(f"schema needs a {KEY} column")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._places: dict[str, int] = {}

    @property
    def _stored(self) -> T.StructType:
        extra = [T.StructField(DELETED, T.BooleanType()), T.StructField(VERSION, T.StringType())]
        return T.StructType(self.schema.fields + extra)

    def _place_on(self, path: str):
        """File system and path object of a path below the table."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _folder(self, name: str) -> str:
        return f"{self.path}/{VERSION}={name}"

    def versions(self) -> list[str]:
        """Names of the stored versions, oldest first."""
        fs, folder = self._place_on(self.path)
        if not fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(folder))
        return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{VERSION}="))

    def _finished(self, name: str) -> int | None:
        """When a version was completed, in milliseconds; None while it is being written or after its writer died."""
        fs, mark = self._place_on(f"{self._folder(name)}/_SUCCESS")
        return fs.getFileStatus(mark).getModificationTime() if fs.exists(mark) else None

    def base(self, names: Sequence[str] | None = None) -> str | None:
        """Newest version that holds all rows and is complete."""
        names = self.versions() if names is None else names
        bases = [n for n in names if (m := _NAME.fullmatch(n)) and int(m[3]) == _STEPS["base"]]
        return next((n for n in reversed(bases) if self._finished(n) is not None), None)

    def _place(self, run: str) -> int:
        """Number of a run: the one it has, or the next one. Listed once per run and process."""
        if run not in self._places:
            known = {m[4]: int(m[1]) for m in map(_NAME.fullmatch, self.versions()) if m}
            self._places[run] = known.get(run, max(known.values(), default=0) + 1)
        return self._places[run]

    def _write(self, rows: DataFrame, version: int, step: str, run: str) -> None:
        name = f"{self._place(run):06d}-{int(version):012d}-{_STEPS[step]}-{run}"
        # sorted by key, so row-group statistics narrow a lookup to few pages
        rows.sortWithinPartitions(KEY).write.mode("overwrite").parquet(self._folder(name))

    def upsert(
        self,
        rows: DataFrame,
        version: int,
        order_by: Sequence[Column] = (),
        run: str = "batch",
        step: str = "upsert",
    ) -> None:
        """Insert or replace by key. With repeats in the batch the first in order wins.

        ``run`` names who counts the versions: for a stream, the id of its checkpoint.
        """
        columns = [
            F.col(f.name).cast(f.dataType)
            if f.name in rows.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in self.schema.fields
        ]
        if order_by:
            rank = F.row_number().over(Window.partitionBy(KEY).orderBy(*order_by))
            rows = rows.withColumn("_rank", rank).filter(F.col("_rank") == 1)
        self._write(rows.select(*columns, F.lit(False).alias(DELETED)), version, step, run)

    def delete(self, keys: DataFrame, version: int, run: str = "batch") -> None:
        """Mark keys as deleted from this version on."""
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != KEY]
        rows = keys.select(KEY).distinct().select(KEY, *blank, F.lit(True).alias(DELETED))
        self._write(rows.select(*self.schema.fieldNames(), DELETED), version, "delete", run)

    def delete_columns(
        self, keys: DataFrame, columns: Sequence[str], version: int, run: str = "batch"
    ) -> None:
        """Empty some columns of the given keys and keep the others."""
        hit = self.read().join(keys.select(KEY).distinct(), KEY, "left_semi")
        dropped = {c: F.lit(None).cast(self.schema[c].dataType) for c in columns}
        self.upsert(hit.withColumns(dropped), version, run=run, step="columns")

    def compact(self, version: int, run: str = "batch") -> None:
        """All current rows as one version after batch ``version``; older ones are no longer read."""
        self.upsert(self.read(), version, run=run, step="base")

    def retire(self, grace_seconds: float) -> list[str]:
        """Remove the versions that a base has replaced for so long; returns their names.

        The grace time lets readers finish that had listed the older versions before the base was complete.
        Names are removed from the oldest on, so a call that is cut short leaves nothing the next one misses.
        """
        if grace_seconds < 0:
            raise ValueError("grace_seconds must not be negative")
        names, now = self.versions(), time.time() * 1000
        old = [n for n in names if _NAME.fullmatch(n)]
        bases = [n for n in old if int(_NAME.fullmatch(n)[3]) == _STEPS["base"]]
        settled = [n for n in bases if (at := self._finished(n)) is not None and now - at >= grace_seconds * 1000]
        retired = [n for n in old if settled and n < settled[-1]]
        for name in retired:
            fs, folder = self._place_on(self._folder(name))
            fs.delete(folder, True)
        return retired

    def log(self, where: Column | None = None) -> DataFrame:
        """Stored rows from the newest base on; folders of older versions are not even listed."""
        names = self.versions()
        base = self.base(names)
        reader = self.spark.read.schema(self._stored)
        if base is None:
            stored = reader.parquet(self.path)
        else:
            stored = reader.option("basePath", self.path).parquet(*[self._folder(n) for n in names if n >= base])
        return stored if where is None else stored.filter(where)

    def read(self, where: Column | None = None, unique: bool = False) -> DataFrame:
        """Current rows; ``where`` may only use the key and is applied at the scan.

        ``unique`` is for a table that no key was written to twice, such as the closed windows of one checkpoint: its rows are
        not ranked, and stay in their tasks.
        """
        if unique:
            return self.log(where).filter(~F.col(DELETED)).select(*self.schema.fieldNames())
        newest = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(VERSION)))
        return (
            self.log(where)
            .withColumn("_rank", newest)
            .filter((F.col("_rank") == 1) & ~F.col(DELETED))
            .select(*self.schema.fieldNames())
        )

    def get(self, key: str, columns: Sequence[str] | None = None) -> DataFrame:
        found = self.read(F.col(KEY) == key)
        return found.select(KEY, *present(found, columns)) if columns else found

    def scan(
        self,
        start: str | None = None,
        stop: str | None = None,
        columns: Sequence[str] | None = None,
        limit: int | None = None,
    ) -> DataFrame:
        """Rows with ``start <= key < stop`` in key order."""
        if limit is not None and limit <= 0:
            raise ValueError("limit must be positive")
        where = F.lit(True)
        if start is not None:
            where = where & (F.col(KEY) >= start)
        if stop is not None:
            where = where & (F.col(KEY) < stop)
        rows = self.read(where)
        if columns:
            rows = rows.select(KEY, *present(rows, columns))
        return rows.orderBy(KEY).limit(limit) if limit is not None else rows

    def compact_into(self, path: str) -> "KeyedTable":
        """Write the current rows as the only version of a new table."""
        target = KeyedTable(self.spark, path, self.schema)
        target.upsert(self.read(), 0)
        return target
