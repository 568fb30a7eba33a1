"""Session settings and the few helpers that look at the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "descry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster sizing stays outside."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # keys that streams remember lie on disk, not in an executor's memory
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings a borrowed session also needs.

    All times are UTC, a repeated key in a line of pairs keeps its last value,
    and a skewed join is split even where that costs one more shuffle.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session without one (a test) gets a temporary folder: on a cluster the
    executors would not find each other's files there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="descry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a table written to the shared folder.

    Like a checkpoint this survives lost executors; unlike one, later readers
    skip columns and row groups they do not need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "descry")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Broadcast ``df`` only after counting that it has at most ``max_rows`` rows.

    A larger side is returned as it is and joined by shuffle.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


#: Most rows of a scan that become documents in one task, about.
ROWS_A_TASK = 100_000


def spread(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """Rows of a scan dealt out to all cores, and to more tasks where they are many.

    For per-document work that costs far more than moving the rows: a split of narrow
    rows holds millions of them, so tasks follow the number of rows, which the files'
    footers tell, and a task's time does not grow with the table.  A scan that already
    has enough splits is left alone.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks)
