"""Merging another instance's archive: first write wins, routed by kind."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.formats import ANNOTATIONS
from descry.operators.archive import type_filter
from descry.operators.keys import skip_processed
from descry.plans.relays import ARCHIVE_COLUMNS
from descry.session import checkpointed
from descry.sinks.archive import PARTITIONS, store_new
from descry.sinks.buckets import BucketedState
from descry.sources.files import FILE_SCHEMA, list_files, literal, path_slices
from descry.sources.state import read_archive

ARCHIVE_SCHEMA = (
    "kind string, published timestamp, digest string, storage_path string, recent_path string, "
    "raw binary, month string"
)
BEGINNING = datetime(1970, 1, 1)


def run_sync(
    spark: SparkSession,
    remote: str,
    archive: str,
    wanted: Iterable[str] = tuple(ANNOTATIONS),
    months: Iterable[str] | None = None,
) -> DataFrame:
    """Append remote documents of wanted kinds that the archive lacks."""
    documents = type_filter(read_archive(spark, remote, wanted, months), wanted)
    rows = documents.select(*ARCHIVE_COLUMNS).withColumn("month", F.col("month").cast("string"))
    return store_new(rows, archive)


def sync_history(state: str) -> BucketedState:
    """The remote's files merged before, by the day they were written."""
    return BucketedState(state, FILE_SCHEMA, ("path", "modificationTime"), "modificationTime", True)


def remote_files(spark: SparkSession, remote: str, wanted: Iterable[str], months=None) -> DataFrame:
    """Files of a remote archive that hold wanted kinds and months, told by their folders."""
    files = list_files(spark, remote, "*.parquet")
    folder = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    files = files.filter(folder("kind").isin(*wanted))
    return files if months is None else files.filter(folder("month").isin(*months))


def continue_sync(
    spark: SparkSession,
    remote: str,
    archive: str,
    state: str,
    wanted: Iterable[str] = tuple(ANNOTATIONS),
    months: Iterable[str] | None = None,
) -> DataFrame:
    """Append what a remote archive has got since the run before; returns the rows stored.

    The remote is known by its files: of one that has not changed nothing is opened, and one
    that was written again is merged again.  Files are remembered slice by slice after they
    are stored, so a run that died goes on where it stopped.
    """
    history = sync_history(state)
    listed = remote_files(spark, remote, list(wanted), months)
    new = checkpointed(
        skip_processed(listed, history.read(spark, BEGINNING), ["path", "modificationTime"])
    )
    stored = []
    for paths in path_slices(new):
        # partition columns are the folders' names
        documents = (
            spark.read.schema(ARCHIVE_SCHEMA)
            .option("basePath", remote)
            .parquet(*[literal(p) for p in paths])
        )
        stored.append(store_new(documents.select(*ARCHIVE_COLUMNS), archive))
        history.insert(new.filter(F.col("path").isin(*paths)), BEGINNING)
    if not stored:
        none = spark.createDataFrame([], f"{ARCHIVE_SCHEMA}, sha1 string, part string")
        return none.select(*[c for c in none.columns if c not in PARTITIONS], *PARTITIONS)
    return reduce(DataFrame.unionByName, stored)
