"""Structured Streaming forms of the incremental jobs.

Files arrive, a micro-batch runs the same operators as the batch jobs.  Batches
may run twice: staging is overwritten per batch, tables are appended to with
first write wins.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from descry.formats import KEEP_ARCHIVE
from descry.functions.digests import without_annotations
from descry.functions.text import as_bytes, as_text
from descry.operators.access_logs import parse_log_path
from descry.plans.access_logs import LogTables, run_access_logs, stage_logs
from descry.operators.documents import split_by_kind
from descry.sources.files import BINARY_SCHEMA, LOG_GLOB


def stream_access_logs(
    spark: SparkSession,
    folder: str,
    tables: LogTables,
    checkpoint: str,
    max_files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Count new log files into staging.

    The stream only carries names; a micro-batch reads its files as the job does and
    stores nothing, so that how files fall into batches changes no result.  When the
    query has ended, ``run_access_logs`` over the same tables tries damaged files again
    and stores the days that are safe.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        stage_logs(parse_log_path(batch), tables, f"batch-{batch_id:012d}")

    names = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("pathGlobFilter", LOG_GLOB)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_batch)
        .load(folder)
        .select("path")
    )
    return (
        names.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_and_store_access_logs(
    spark: SparkSession,
    folder: str,
    tables: LogTables,
    checkpoint: str,
    now: datetime,
    limits: bool = True,
    max_files_per_batch: int = 10_000,
) -> DataFrame:
    """Stream what has arrived, then decide and store once; returns the days stored."""
    stream_access_logs(spark, folder, tables, checkpoint, max_files_per_batch).awaitTermination()
    return run_access_logs(spark, folder, tables, now, limits)


def stream_descriptors(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    max_files_per_batch: int = 1_000,
    remember: timedelta = KEEP_ARCHIVE,
) -> StreamingQuery:
    """Split new descriptor files and append documents that have not come before.

    Which digests have come is the query's own state, kept by key and forgotten ``remember``
    after it arrived; a micro-batch looks up the keys it holds and reads nothing that is
    stored.  A batch that is repeated overwrites its own folder, so it adds nothing.  The
    table belongs to its checkpoint: another checkpoint knows nothing of it.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        (
            batch.select("digest", "path", "raw", "kind")
            .withColumn("batch", F.lit(f"{_query_name(spark, checkpoint)}-{batch_id:012d}"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("kind", "batch")
            .parquet(table)
        )

    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_batch)
        .load(folder)
    )
    documents = split_by_kind(files.select("path", F.col("content").alias("raw")))
    body = as_bytes(without_annotations(as_text(F.col("raw"))))
    # the time of the batch: no document is late, whatever the time it tells
    first = (
        documents.withColumns({"digest": F.sha2(body, 256), "arrived": F.current_timestamp()})
        .withWatermark("arrived", f"{int(remember.total_seconds())} seconds")
        .dropDuplicatesWithinWatermark(["kind", "digest"])
    )
    return (
        first.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _query_name(spark: SparkSession, checkpoint: str) -> str:
    """The query's id, which its checkpoint keeps; batches of two checkpoints never meet."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
