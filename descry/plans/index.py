"""The file index, end to end: listing to reconciled index to JSON."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.operators.catalog import (
    apply_reconciliation,
    index_file,
    index_parts,
    listable,
    reconcile_index,
)
from descry.session import checkpointed
from descry.sinks.files import export_index_json
from descry.sinks.tables import save_state
from descry.sources.files import list_files, path_slices, read_binary
from descry.sources.packed import ARCHIVES, ArchiveMembers, FilePieces, read_parts
from descry.sources.state import read_state

INDEX_SCHEMA = (
    "path string, size bigint, last_modified timestamp, types array<string>, "
    "first_published timestamp, last_published timestamp, sha256 string, "
    "marked_for_deletion timestamp"
)


#: Files from this size on are read in pieces, not as one row.
LARGE_FILE = 256 << 20


def indexed_files(
    spark: SparkSession, wanted: DataFrame, large_file: int = LARGE_FILE, **options: int
) -> DataFrame:
    """Index facts of the files in ``wanted`` (path, length, modificationTime).

    Archives are opened member by member and large files piece by piece, so no row holds
    one; both are hashed on the way.
    """
    archive = F.lit(False)
    for suffix in ARCHIVES:
        archive |= F.col("path").endswith(suffix)
    large = F.col("length") >= large_file
    found = index_file(read_binary(spark, wanted.filter(~archive & ~large)))
    times = wanted.select("path", F.date_trunc("minute", "modificationTime").alias("last_modified"))
    for source, files in ((ArchiveMembers, wanted.filter(archive)), (FilePieces, wanted.filter(~archive & large))):
        for paths in path_slices(files):
            parts = read_parts(spark, source, paths, **options).select("path", "raw", "size", "sha256")
            found = found.unionByName(index_parts(parts).join(times, "path"))
    return found


def run_index(
    spark: SparkSession, folder: str, state: str, now: datetime, json_path: str | None = None
) -> DataFrame:
    """Bring the index up to date; only new and changed files are opened."""
    index = read_state(spark, state, INDEX_SCHEMA)
    files = checkpointed(listable(list_files(spark, folder)))
    listing = files.select(
        "path", F.date_trunc("minute", "modificationTime").alias("last_modified")
    )
    plan = checkpointed(reconcile_index(index, listing, now))
    wanted = files.join(plan.filter("action = 'index'").select("path"), "path", "left_semi")
    indexed = indexed_files(spark, wanted)
    updated = checkpointed(apply_reconciliation(index, plan, indexed))
    save_state(updated, state, now)
    if json_path:
        # whatever scheme and host the listing put before the folder
        inside = folder.split(":", 1)[-1].strip("/")
        relative = F.regexp_replace("path", r"\A.*?/\Q" + inside + r"\E/+", "")
        export_index_json(
            updated.withColumn("path", relative), json_path, now.strftime("%Y-%m-%d %H:%M")
        )
    return updated
