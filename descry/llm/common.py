"""Expressions and helpers that several of the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from descry.session import shared_folder

#: White space between words: blank, tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(column: Column | str) -> Column:
    """The text, a null one as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between runs of white space; no word gives an empty array."""
    trimmed = F.trim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+", -1)
    )


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hidden(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns under names with a prefix, beside new columns that can't clash with them."""
    renamed = [F.col(f"`{c}`").alias(f"__{c}") for c in df.columns]
    return df.select(*renamed, *[c.alias(name) for name, c in columns.items()])


def shown(df: DataFrame) -> list[Column]:
    """The hidden columns under their own names."""
    return [F.col(f"`{c}`").alias(c[2:]) for c in df.columns if c.startswith("__")]


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` together, or of one larger row."""
    start, size = 0, 0
    for row, own in enumerate(sizes.tolist()):
        if row > start and size + own > most:
            yield start, row
            start, size = row, 0
        size += own
    if start < len(sizes):
        yield start, len(sizes)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    """The rows as a table at ``path``, which later steps read."""
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder whose tables nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def prefix_sums(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: str, into: str
) -> DataFrame:
    """Exclusive running sum of ``value`` within each group, in two levels.

    ``bucket`` must not decrease along the order (``bucket``, then ``order``).  Sums of
    whole buckets are formed first, with a combine before the shuffle, and only those
    meet in one task for a group; rows are summed inside their bucket.  A group may
    therefore hold any share of the rows.  ``df`` has to give the same rows each time it
    is computed.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(F.asc_nulls_first(bucket))
    offsets = sums.select(
        *[F.col(k).alias(f"{k}_of_sum") for k in keys],
        F.coalesce(
            F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of_sum")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition &= c
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*[F.asc_nulls_first(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return running.join(offsets, condition, "left").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_inside") + F.col("_offset")).alias(into)
    )
