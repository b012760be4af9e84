"""Shards by fixed virtual slots: record -> slot by hash, slot -> shard by a stored, versioned map.

The slot of a record never changes. Bytes and rows are summed per slot (one row per slot and
task reaches the shuffle); the map is laid out from these sums, heaviest slot first into the
lightest shard. Rebalancing edits the map: overfull shards give up their lightest slots, which
are dealt again; every other slot stays where it is. All of it is DataFrame code; the only data
that meets in one task is one row per slot, whose number is fixed.

Defined cases. A null text has no bytes. Null doc_ids are spread by the hash of their text.
Rows that are equal in doc_id and text share a slot. An empty table gives an empty map and no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from .common import written

SLOTS = 4096
ROW_BYTES = 8


def slot_of(slots: int = SLOTS) -> Column:
    """Virtual slot of a record. Copies of a text differ in doc_id, so they do not share one."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots))


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", slot_of(slots))


def slot_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(slots: Column, loads: Column) -> Column:
    """Shard of each slot of a sorted array: in turn, the shard with the fewest bytes so far."""

    def place(done: Column, slot: Column) -> Column:
        lightest = F.array_position(done["loads"], F.array_min(done["loads"])).cast("int") - 1
        # bound once: the lambda below would work it out again for every shard
        return F.transform(
            F.array(lightest),
            lambda at: F.struct(
                F.transform(done["loads"], lambda x, k: F.when(k == at, x + slot["bytes"]).otherwise(x)).alias("loads"),
                F.concat(done["shards"], F.array(at)).alias("shards"),
            ),
        )[0]

    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<int>)").alias("shards"))
    return F.aggregate(slots, start, place, lambda done: done["shards"])


def _deal(sums: DataFrame, n_shards: int, loads: DataFrame | None = None) -> DataFrame:
    """virtual_slot, shard for ``sums``, on top of the bytes that ``loads`` (shard, bytes) has."""
    entry = F.struct((-F.col("bytes")).alias("down"), F.col("virtual_slot"), F.col("bytes"))
    held = {} if loads is None else {r["shard"]: r["bytes"] for r in loads.collect()}  # one row per shard
    start = F.array(*[F.lit(held.get(k, 0)).cast("long") for k in range(n_shards)])
    df = sums.agg(F.sort_array(F.collect_list(entry)).alias("s")).withColumn("loads", start)
    df = df.withColumn("shards", _dealt(F.col("s"), F.col("loads")))
    pairs = F.explode(F.arrays_zip("s.virtual_slot", "shards"))
    return df.select(pairs.alias("x")).select("x.virtual_slot", F.col("x.shards").alias("shard"))


class SlotMap:
    """Versions of a slot-to-shard map, each a small table in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "slot-map")
        # a map that was stored before goes on from its newest version
        self.version = self._newest() if path else 0

    def _newest(self) -> int:
        try:
            return self.history().agg(F.max("version")).first()[0] or 0
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def history(self) -> DataFrame:
        """virtual_slot, shard and version of all versions."""
        return self.spark.read.schema("virtual_slot long, shard int, version int").parquet(self.path)

    def since(self, version: int) -> DataFrame:
        """The map of a version, with the version at which each slot came to its shard (``version``)."""
        order = Window.partitionBy("virtual_slot").orderBy("version")
        came = ~F.lag("shard").over(order).eqNullSafe(F.col("shard"))
        steps = self.history().where(F.col("version") <= version).withColumn("came", came).where("came")
        return steps.groupBy("virtual_slot").agg(
            F.max_by("shard", "version").alias("shard"), F.max("version").alias("version"))

    def _store(self, rows: DataFrame) -> DataFrame:
        self.version += 1
        rows.coalesce(1).write.parquet(f"{self.path}/version={self.version}")
        return self.read()

    def read(self, version: int | None = None) -> DataFrame:
        at = f"{self.path}/version={version or self.version}"
        return self.spark.read.schema("virtual_slot long, shard int").parquet(at)

    def lay_out(self, sums: DataFrame, n_shards: int) -> DataFrame:
        return self._store(_deal(sums, n_shards))

    def rebalance(self, sums: DataFrame, n_shards: int) -> DataFrame:
        """A next version for new sums or more shards; only slots of overfull shards and new slots move."""
        # n_shards may have grown: a shard's fair share is of the new number
        df = sums.join(self.read(), "virtual_slot", "left")
        share = (sums.agg(F.sum("bytes")).first()[0] or 0) / n_shards
        order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
        df = df.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        stays = F.col("shard").isNotNull() & (F.col("shard") < n_shards) & (F.col("upto") <= share)
        df = written(df.withColumn("stays", F.coalesce(stays, F.lit(False))), "slot-moves")
        kept = df.where("stays")
        loads = kept.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
        moved = _deal(df.where("not stays"), n_shards, loads)
        return self._store(kept.select("virtual_slot", "shard").unionByName(moved))


def sharded(docs: DataFrame, n_shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Place of every record: its shard, and its slot there, counted from 0 without gaps."""
    spark = docs.sparkSession
    rows = written(sized(docs, slots), "sized-records")
    sums = written(slot_sums(rows).repartition(1), "slot-sums")
    shards = SlotMap(spark).lay_out(sums, n_shards)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(shards, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    # one row per slot, so its size is bound by the number of slots
    placed = rows.join(F.broadcast(starts), "virtual_slot")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("slot", F.col("start") + F.row_number().over(inside) - 1).drop("start")


class ShardStore:
    """Whole records in the folders of their shards, under a stored slot map.

    A record lies in ``rows/version=v/shard=k``, where ``v`` is the version at which its slot came to the shard.
    Rebalancing stores the next map and writes only the records of slots that move; the others stay where they
    are. A version counts for readers once its records are there, and a store that is opened after a
    crash finishes its move. All input columns are in ``row``, so no name clashes.
    """

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path.rstrip("/"), slots
        self.map = SlotMap(spark, f"{self.path}/map")
        self._moved = SlotMap(spark, f"{self.path}/moved")
        self._finish()

    def _finish(self) -> None:
        while self._moved.version < self.map.version:
            version = self._moved.version + 1
            if version > 1:
                coming = self.map.since(version).where(F.col("version") == version).drop("version")
                rows = self.rows().drop("shard").join(F.broadcast(coming), "virtual_slot")
                self._write(rows, version, "overwrite")
            self._moved._store(self.map.read(version))

    def _write(self, rows: DataFrame, version: int, mode: str) -> None:
        # a hot shard is split over tasks, small ones share a task
        rows.hint("rebalance", F.col("shard")).write.mode(mode).partitionBy("shard").parquet(
            f"{self.path}/rows/version={version}")

    def add(self, docs: DataFrame, n_shards: int = 24) -> None:
        """Append documents; the first batch lays the map out, later ones go where their slots are."""
        names = [F.col(f"`{c}`") for c in docs.columns]
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = docs.select(
            F.struct(*names).alias("row"), "doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ).withColumn("virtual_slot", slot_of(self.slots))
        if self.map.version == 0:
            # every slot is laid out, so later records find their shard
            every = self.spark.range(self.slots).select(F.col("id").alias("virtual_slot"))
            sums = every.join(slot_sums(rows), "virtual_slot", "left").fillna(0)
            self.map.lay_out(written(sums, "slot-sums"), n_shards)
            self._finish()
        # one row per slot; a slot's records lie at the version at which it came to its shard
        homes = F.broadcast(self.map.since(self.map.version))
        placed = rows.join(homes, "virtual_slot").select("row", "size", "virtual_slot", "shard", "version")
        placed.hint("rebalance", F.col("version"), F.col("shard")).write.mode("append").partitionBy(
            "version", "shard").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        """row, size, virtual_slot and shard of every record."""
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        homes = F.broadcast(self.map.since(self._moved.version))
        return stored.join(homes, ["virtual_slot", "shard", "version"], "left_semi").drop("version")

    def rebalance(self, n_shards: int) -> None:
        sums = self.rows().groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        every = self.map.read().select("virtual_slot")
        self.map.rebalance(written(every.join(sums, "virtual_slot", "left").fillna(0), "slot-sums"), n_shards)
        self._finish()
