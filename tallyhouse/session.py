"""Session helpers: settings the library relies on, and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Safe defaults for a cluster; a caller's own settings win because they are
#: only applied by :func:`build_session`.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

#: State that a batch has evicted leaves the memory with the batch, not with the one after it.
ONE_VERSION = {"spark.sql.streaming.maxBatchesToRetainInMemory": "1"}

#: Shuffle files of a statement are removed when it has ended, not when the driver collects its garbage.
FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(
    app_name: str = "tallyhouse",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the defaults above; leave ``master`` out under spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The given settings hold inside, for what is started there as well; those of before hold again after it."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def pin_utc(spark: SparkSession) -> SparkSession:
    """All event times are UTC; dates and hours derive from the session zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


#: Bytes of stored input per shuffle partition; adaptive execution puts small partitions together again,
#: up to so many shuffled bytes, which are several times as many in a sort.
SHUFFLE_BYTES, TASK_BYTES = 4 * 2**20, 16 * 2**20


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path; 0 where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(place).getLength() if fs.exists(place) else 0


def size_shuffles(spark: SparkSession, root: str) -> SparkSession:
    """More shuffle partitions for a larger input folder, so that no task sorts or joins more rows as it grows.

    Only the number that adaptive execution starts from is set, never below ``spark.sql.shuffle.partitions``, and for
    larger inputs the size it puts partitions together to; the state of streams and sessions that do not coalesce keep
    their own number.
    """
    size = stored_bytes(spark, root)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, -(-size // SHUFFLE_BYTES))))
    if -(-size // SHUFFLE_BYTES) > least:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the cluster does not name one, a temporary folder is made, but only
    for a local master: on a cluster it would not be visible to executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOTS[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
