"""Archive of lines by hour in files of bounded size; a batch closes its files, a replay writes the same.

Lines are dealt into cells by their hash, bytes are summed per hour and cell, and the cells of an hour are
laid end to end: a file takes the cells that begin in its stretch. A stretch is shorter than the limit
by the largest cell, so no file passes it. An hour whose cells are not small against the limit is dealt into more
cells, by a second pass over the batch. A cell above half the limit holds lines that repeat
often; its lines are counted, and the copies are dealt over files by their place. Nothing depends on tasks or
on the order of rows, so a replayed batch makes the same files.

Defined cases. A null line is left out, an empty one is a byte. Lines are not cut: one longer than the limit
has a file of its own. Lines without a time share the folder of null. An empty batch is logged without files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import struct
from .files import SINK_PARTITIONS

LIMIT_BYTES = 128 * 1024 * 1024
#: Cells of an hour: more of them fill files better, and the layout of an hour has this many rows at most, or
#: FINE rows per file where that is more.
CELLS = 4096
#: Cells that a file takes at least on average; with fewer, the stretch is cut short by the largest of them.
FINE = 32
HOUR = list(SINK_PARTITIONS)
FOLDERS = ", ".join(f"{c} STRING" for c in HOUR)
LOG = struct(f"{FOLDERS}, file STRING, lines BIGINT, bytes BIGINT, run STRING, batch BIGINT")


class RolledArchive:
    """``foreachBatch`` body and reader; with a trigger of 60 seconds a file is closed after that time or at its limit.

    The log of a batch names its files and is written last; readers see logged batches only.
    """

    def __init__(self, spark: SparkSession, path: str, limit_bytes: int = LIMIT_BYTES, cells: int = CELLS):
        if limit_bytes < 2 or cells < 1:
            raise ValueError("limit_bytes must be at least 2 and cells at least 1")
        self.spark, self.path = spark, path.rstrip("/")
        self.limit, self.cells = limit_bytes, cells

    def _cells(self, lines: DataFrame) -> DataFrame:
        """One row per hour and cell: its sums and, for a light cell, its file."""
        sums = lines.groupBy(*HOUR, "hour", "cell").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("lines"), F.max("size").alias("longest"))
        sums = sums.withColumn("heavy", F.col("bytes") > self.limit // 2)
        group = Window.partitionBy("hour", "heavy")
        before = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        stretch = self.limit - F.max("bytes").over(group)
        place = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / stretch)
        return sums.withColumn("file", F.when(~F.col("heavy"), F.format_string("%06d", place)))

    def _repeats(self, lines: DataFrame, heavy: DataFrame) -> DataFrame:
        """Lines of heavy cells, one row per line and file with the number of copies there."""
        counted = (
            lines.join(heavy.select("hour", "cell"), ["hour", "cell"])
            .groupBy(*HOUR, "hour", "cell", "value", "size")
            .agg(F.count(F.lit(1)).alias("n"))
            # a line above half the limit has a file of its own: it is one step long, as is its stretch
            .withColumn("own", F.col("size") > self.limit // 2)
            .withColumn("step", F.when(F.col("own"), F.lit(1)).otherwise(F.col("size")))
        )
        group = Window.partitionBy("hour", "cell", "own")
        before = group.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumns({
            "start": F.coalesce(F.sum(F.col("n") * F.col("step")).over(before), F.lit(0)),
            # without the longest line there is room for the one that begins last in the stretch
            "stretch": F.when(F.col("own"), F.lit(1)).otherwise(self.limit - F.max("step").over(group) + 1),
        })
        first = F.expr("start DIV stretch")
        last = F.expr("(start + (n - 1) * step) DIV stretch")
        spread = counted.withColumn("k", F.explode(F.sequence(first, last)))
        reach = lambda k: F.least(
            F.greatest(F.ceil((k * F.col("stretch") - F.col("start")) / F.col("step")), F.lit(0)), F.col("n"))
        spread = spread.withColumn("copies", reach(F.col("k") + 1) - reach(F.col("k"))).filter("copies > 0")
        return spread.withColumn("file", F.concat(
            F.when(F.col("own"), "l").otherwise("c"), F.format_string("%04d-%06d", "cell", "k")))

    def _stored(self, made: DataFrame, path: str) -> DataFrame:
        made.write.mode("overwrite").parquet(f"{self.path}/{path}")
        return self.spark.read.schema(made.schema).parquet(f"{self.path}/{path}")

    def write(self, rows: DataFrame, version: int, run: str = "batch") -> None:
        """``rows`` has ``value`` and the folder columns; a version that is written again replaces itself."""
        at = f"run={run}/batch={version}"
        lines = rows.filter(F.col("value").isNotNull()).select(
            "value", *HOUR, F.concat_ws("/", *HOUR).alias("hour"),
            F.xxhash64("value").alias("hash"),
            (F.octet_length("value") + 1).cast("long").alias("size"))
        dealt = lines.withColumn("cell", F.pmod("hash", F.lit(self.cells)))
        cells = self._stored(self._cells(dealt), f"layout/{at}")
        times = F.ceil(F.sum("bytes") * (FINE / (self.limit * self.cells))).alias("times")
        large = self._stored(cells.groupBy("hour").agg(times).filter("times > 1"), f"large/{at}")
        if not large.isEmpty():
            dealt = lines.join(large, "hour", "left").withColumn(
                "cell", F.pmod("hash", self.cells * F.coalesce("times", F.lit(1)))).drop("times")
            cells = self._stored(self._cells(dealt), f"fine_layout/{at}")
        lines = dealt
        light, heavy = cells.filter(~F.col("heavy")), cells.filter("heavy")
        out = lines.join(light.select("hour", "cell", "file"), ["hour", "cell"]).select("value", *HOUR, "file")
        out = out.repartition("file", *HOUR)
        log = light.select(*HOUR, "file", "lines", "bytes")
        if not heavy.isEmpty():
            repeats = self._repeats(lines, heavy)
            copies = repeats.repartition("file", *HOUR).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            out = out.unionByName(copies.select("value", *HOUR, "file"))
            log = log.unionByName(repeats.select(
                *HOUR, "file", F.col("copies").alias("lines"), (F.col("copies") * F.col("size")).alias("bytes")))
        out.write.mode("overwrite").partitionBy(*HOUR, "file").text(f"{self.path}/rows/{at}")
        log.groupBy(*HOUR, "file").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes")).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/log/{at}")

    def log(self) -> DataFrame:
        """One row per file: folders, name, lines, bytes, run and batch."""
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def read(self) -> DataFrame:
        schema = struct(f"value STRING, run STRING, batch BIGINT, {FOLDERS}, file STRING")
        rows = self.spark.read.schema(schema).text(f"{self.path}/rows")
        return rows.join(self.log().select("run", "batch").distinct(), ["run", "batch"], "left_semi")
