"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for right results.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.javaCharsets": "true",  # GBK, Big5 and GB18030 in encode/decode
    "spark.sql.legacy.codingErrorAction": "true",  # unmappable characters are replaced, not an error
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # map_concat as a shallow object merge
}

# Removes the shuffle files of a statement when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# The folder of each local session that was started without one.
_LOCAL_ROOTS: dict[str, str] = {}


def build_session(
    app: str = "folioflow", master: str | None = None, partitions: int | None = None, memory: str | None = None
) -> SparkSession:
    """A session with adaptive execution on; partition counts and memory stay with the cluster unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # No call-site lookup for every column expression; this one is fixed when a session starts.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime settings the operators need on a session made elsewhere."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stream state.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a folder of its own, because a machine-local folder does not
    survive the loss of an executor.
    """
    local = spark.sparkContext.master.split("[")[0] == "local"
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="folioflow-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Statements in here take their shuffle files with them when they end, and so do streams that start in here."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of an iterative step by writing it to the shared folder.

    The shuffle files of the write go when it has ended: nothing reads them again, because the rows come from the folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with tidy(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """Write a table in buckets of ``key`` to the shared folder and read it back.

    Rows of a key stay together, so later joins, windows and aggregates on it need no exchange. ``df`` should be
    distributed by ``repartition(n, key)`` into as many partitions as ``spark.sql.shuffle.partitions``, or come from
    such a frame by narrow steps, so that each task writes one bucket.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, key).option("path", scratch_path(spark, label))
    writer.saveAsTable(name)
    out = spark.table(name)
    # The frame knows files and buckets by now; the catalog need not keep the name.
    spark.sql(f"drop table {name}")
    return out
