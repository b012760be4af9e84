"""Removal of lines that many documents share, on levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, keeper), bucketed and sorted by h1. Batches arrive from
the largest doc_id down. A batch's keys are merge-anti-joined with the runs: a key that no
run holds is fresh, and its keeper is the batch's largest doc_id; a key seen before adds its
count only. The batch's keys become a new run of level 0. When a level holds ``fanout`` runs
they are folded into one run of the next level, so the number of runs stays logarithmic.

Lines are known by 128 bits of two independently seeded hashes. Counts are combined before
each shuffle, so a line that a third of all documents hold costs one row per task. Texts move
once, in the last join, by document and never by line.

Defined cases. Null and empty texts are one empty line. Rows with an equal doc_id are separate
documents for the count; all of those with the largest doc_id keep the line. A null doc_id is
below every number; if no holder has a doc_id, all keep the line. Extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .common import BLANKS, fold_ascii, written

KEY = ["h1", "h2"]


class LineRuns:
    """Levelled runs in the shared folder; ``levels[k]`` lists level k as (table, folder)."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark = spark
        self.fanout = fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, keys: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex[:12]}", scratch(self.spark, "line-run")
        (
            keys.repartition(self.buckets, "h1")
            .write.bucketBy(self.buckets, "h1")
            .sortBy("h1", "h2")
            .option("path", path)
            .saveAsTable(name)
        )
        return name, path

    def runs(self) -> list[DataFrame]:
        """The runs as bucketed tables: a join on h1 shuffles the batch only."""
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` that no run holds: one merge-anti-join for each run."""
        for run in self.runs():
            keys = keys.join(run.select(*KEY), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """``keys`` (h1, h2, n_docs, keeper), one row per key, becomes a run."""
        if self.runs():
            fresh = written(self.fresh(keys), "fresh-keys")
            # the keeper of a known key stands in the run that met it first
            known = keys.join(fresh.select(*KEY), KEY, "left_anti")
            keys = fresh.unionByName(known.withColumn("keeper", F.lit(None).cast("long")))
        self._push(0, self._write(keys))

    def _push(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            folded = self._write(self._folded(self.levels[level]))
            self.levels[level] = []
            self._push(level + 1, folded)

    def _folded(self, runs: list[tuple[str, str]]) -> DataFrame:
        # read as plain files: a union of bucketed tables claims a partitioning that it does not
        # have, and the sums would stay apart
        every = self.spark.read.schema("h1 long, h2 long, n_docs long, keeper long").parquet(*[path for _, path in runs])
        return every.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def totals(self) -> DataFrame:
        runs = [run for level in self.levels for run in level]
        return self.spark.table(runs[0][0]) if len(runs) == 1 else self._folded(runs)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line with a long key: doc_id, row_hash, pos, h1, h2, first.

    ``first`` is 1 on one line of each key in a document, so that its sum counts documents.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = F.transform(_lines(fold_ascii(text)), lambda x: F.btrim(x, F.lit(BLANKS)))
    df = docs.select("doc_id", F.xxhash64(text).alias("row_hash"), keys.alias("keys"))
    hashed = F.transform(
        "keys",
        lambda k, i: F.when(
            F.length(k) >= min_chars,
            F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"), i.alias("pos")),
        ),
    )
    df = df.select("doc_id", "row_hash", F.sort_array(F.filter(hashed, lambda x: x.isNotNull())).alias("s"))

    def flagged(x: Column, k: Column) -> Column:
        before = F.get(F.col("s"), k - 1)
        again = F.coalesce((before["h1"] == x["h1"]) & (before["h2"] == x["h2"]), F.lit(False))
        return F.struct(x["pos"].alias("pos"), x["h1"].alias("h1"), x["h2"].alias("h2"), F.when(again, 0).otherwise(1).alias("first"))

    # the sorted array has two readers here, so it is built once and not again for each line
    return df.select("doc_id", "row_hash", F.explode(F.transform("s", flagged)).alias("x")).select("doc_id", "row_hash", "x.*")


def without_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4) -> DataFrame:
    """``row`` (the input row), ``n_lines``, ``n_dropped`` and ``kept_text`` per document."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(batches - 1, 0, -1)], 10000)).first()[0] or []
    # batch 0 has the largest ids; a null id is in the last batch
    batch = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        batch = F.when(F.col("doc_id") > cuts[k], k).otherwise(batch)
    path = scratch(spark, "line-hashes")
    long_lines(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = "doc_id long, row_hash long, pos int, h1 long, h2 long, first int, batch int"
    lines = spark.read.schema(schema).parquet(path)

    runs = LineRuns(spark, fanout)
    for k in range(len(cuts) + 1):
        own = lines.where(F.col("batch") == k)
        runs.add(own.groupBy(*KEY).agg(F.sum("first").alias("n_docs"), F.max("doc_id").alias("keeper")))
    shared = runs.totals().where((F.col("n_docs") >= min_docs) & F.col("keeper").isNotNull()).select(*KEY, "keeper")
    shared = written(shared, "shared-lines")

    lost = lines.join(shared, KEY).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("lost"))
    lost = written(lost.withColumnsRenamed({"doc_id": "lost_id", "row_hash": "lost_hash"}), "lost-lines")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"))
    same = F.col("row.doc_id").eqNullSafe(F.col("lost_id")) & (F.col("row_hash") == F.col("lost_hash"))
    # merged at every size: the table of lost lines grows with the corpus
    df = rows.join(lost.hint("merge"), same, "left").select("row", "lost", _lines(F.col("row.text")).alias("lines"))
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), "lost")
    df = df.select("row", "lost", "lines", n.alias("n"), F.when(F.col("lost").isNotNull(), kept).alias("kept"))
    return df.select(
        "row",
        F.col("n").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.coalesce("row.text", F.lit("")))
        .otherwise(F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n"))
        .alias("kept_text"),
    )
