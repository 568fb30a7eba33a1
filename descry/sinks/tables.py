"""Tables: append what is new, overwrite partitions, save state.

Plain Parquet has no transactions, so one writer per table is assumed.  Every
write can be repeated: what is already there is not written again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.operators.keys import keep_first, overwritten, skip_processed
from descry.session import checkpointed
from descry.sources.state import drop_old_versions, read_table

#: A run that dies while saving, or still reads, finds the version before.
VERSIONS_KEPT = 2
#: Values of one partition column that become literals of a filter; with more of them the
#: column prunes nothing.
MOST_TOUCHED = 1_000


def schema_of(df: DataFrame, partitions: Sequence[str] = ()) -> str:
    """DDL with partition columns last, as a partitioned table reads back."""
    fields = [f for f in df.schema.fields if f.name not in partitions]
    fields += [df.schema[p] for p in partitions]
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def touched_by(existing: DataFrame, rows: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Rows of a stored table in the partitions that ``rows`` may fall in.

    The values of each partition column become literals, so other folders are not listed
    among the files to read.  ``rows`` should be a written table: only its partition
    columns are read here.
    """
    if not partitions:
        return existing
    found = rows.agg(
        *[F.slice(F.collect_set(c), 1, MOST_TOUCHED + 1).alias(c) for c in partitions],
        *[F.max(F.col(c).isNull()).alias(f"__null_{c}") for c in partitions],
    ).first()
    for c in partitions:
        if len(found[c]) <= MOST_TOUCHED:
            inside = F.col(c).isin(*found[c])
            existing = existing.filter(inside | F.col(c).isNull() if found[f"__null_{c}"] else inside)
    return existing


def write_new_only(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str],
    partitions: Sequence[str] = (),
) -> DataFrame:
    """Append rows whose key the table lacks; returns exactly the rows written.

    A key must always come with the same partition: only the partitions of the incoming
    rows are searched for it, and of those only the keys are read.  The rows are written
    out before the append: computed again afterwards they would compare against the grown
    table.  Rows are clustered by partition with AQE splitting large ones, so a month with
    most of the data is written by many tasks.
    """
    spark = df.sparkSession
    unique = checkpointed(keep_first(df, keys, order))
    existing = read_table(spark, path, schema_of(unique, partitions))
    fresh = checkpointed(skip_processed(unique, touched_by(existing, unique, partitions), keys))
    writer = fresh.hint("rebalance", *partitions) if partitions else fresh
    writer.write.mode("append").partitionBy(*partitions).parquet(path)
    return fresh


def write_overwrite(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str],
    partitions: Sequence[str],
) -> DataFrame:
    """Last write wins: rewrite only the partitions the rows fall in."""
    spark = df.sparkSession
    existing = read_table(spark, path, schema_of(df, partitions))
    touched = df.select(*partitions).distinct()
    stored = touched_by(existing, df, partitions).join(touched, list(partitions), "left_semi")
    merged = checkpointed(overwritten(stored, df, keys, order))
    (
        merged.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )
    return merged


def save_state(df: DataFrame, path: str, run: datetime) -> None:
    """Save a state table as the version of this run; the version before it stays.

    Pass this run's keys to forget inputs that vanished, or
    ``keys.accumulate(old, new, …)`` to remember everything.
    """
    version = run.strftime("%Y%m%d%H%M%S")
    (
        df.withColumn("run", F.lit(version))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .parquet(path)
    )
    drop_old_versions(df.sparkSession, path, keep=VERSIONS_KEPT)
