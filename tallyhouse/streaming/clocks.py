"""Lateness against a clock per feed: a row is judged by what its own feed had delivered by its own arrival.

A feed is what delivers in order, such as a partition of a topic or a device. Labels change inside a
micro-batch, and a slow feed is not late because another runs ahead. The watermark of the whole stream is the
lowest of the feeds.

Defined cases. Rows that arrive at the same instant see the same watermark. A row without an arrival
time counts as arriving last in its micro-batch; one without an event time is on time and moves no
clock. Rows without a feed have a clock of their own. An empty micro-batch hands the clocks on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..schemas import struct
from .sinks import run_of

CLOCK = struct("_feed STRING, _high BIGINT")
#: Later than any arrival, in microseconds.
LAST = 2**63 - 1


class FeedClocks:
    """``foreachBatch`` body that stores rows with ``watermark`` and ``lateness`` by the clock of their feed.

    The state is the highest event time per feed, a small table per batch that the next batch reads; a
    replayed batch reads and writes the same. A batch is first reduced to one row per feed and arrival instant,
    in each task before the shuffle, so the running max of a busy feed has its instants in a task and not its rows.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        feed: str,
        bound_seconds: int = W.OUT_OF_ORDERNESS_SECONDS,
        lateness_seconds: int = W.ALLOWED_LATENESS_SECONDS,
    ):
        self.spark, self.path, self.feed = spark, path.rstrip("/"), feed
        self.bound_seconds, self.lateness_seconds = bound_seconds, lateness_seconds

    def _clocks(self, run: str, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], CLOCK)
        return self.spark.read.schema(CLOCK).parquet(f"{self.path}/clocks/run={run}/batch={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch)
        at = f"run={run}/batch={batch_id}"
        before = self._clocks(run, batch_id - 1)
        rows = batch.withColumns({
            "_feed": F.coalesce(F.concat(F.lit("="), F.col(self.feed).cast("string")), F.lit("")),
            "_at": F.coalesce(F.unix_micros("ingestion_timestamp"), F.lit(LAST)),
        })
        instants = rows.groupBy("_feed", "_at").agg(F.max(F.unix_micros("event_timestamp")).alias("_max"))
        running = F.max("_max").over(Window.partitionBy("_feed").orderBy("_at"))
        # greatest leaves nulls out
        made = instants.join(before, "_feed", "left").select("_feed", "_at", F.greatest(running, "_high").alias("_high"))
        made.write.mode("overwrite").parquet(f"{self.path}/instants/{at}")
        known = self.spark.read.schema(made.schema).parquet(f"{self.path}/instants/{at}")
        watermark = W.calculate_watermark(F.timestamp_micros("_high"), self.bound_seconds)
        labelled = rows.join(known, ["_feed", "_at"]).withColumn("watermark", watermark).drop("_feed", "_at", "_high")
        labelled = labelled.withColumn("lateness", W.lateness_label("event_timestamp", "watermark", self.lateness_seconds))
        labelled.write.mode("overwrite").partitionBy("lateness").parquet(f"{self.path}/rows/{at}")
        # the clocks come last: a batch without them is replayed whole
        after = before.unionByName(known.select("_feed", "_high")).groupBy("_feed").agg(F.max("_high").alias("_high"))
        after.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clocks/{at}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")


def lowest_watermark(labelled: DataFrame, feed: str) -> DataFrame:
    """The watermark of the whole stream, over stored labels: the lowest of the feeds' highest."""
    return labelled.groupBy(feed).agg(F.max("watermark").alias("watermark")).agg(F.min("watermark").alias("watermark"))
