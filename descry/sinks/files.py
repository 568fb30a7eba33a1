"""Text files for people: log archives, concatenated recent files, the index.

Spark writes folders of part files; parts in name order are the file.  Large
files are cut into several parts by range, so none passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.operators.access_logs import count_chunks, repeat_chunks
from descry.operators.archive import recent_order, with_archive_paths
from descry.operators.catalog import index_tree


def write_log_archive(counts: DataFrame, path: str, compression: str = "bzip2") -> None:
    """Sanitized lines per host pair and day, sorted, each as often as counted.

    Counts are sorted, cut into chunks, and repeated only after the shuffle.  The
    sort key includes the chunk, so the copies of one hot line are spread over
    range partitions as well.
    """
    dated = with_archive_paths(counts, "access-log", time="log_date")
    keys = ["storage_path", "line", "first_copy"]
    chunks = count_chunks(dated.select("storage_path", "line", "n"))
    ordered = chunks.repartitionByRange(*keys).sortWithinPartitions(*keys)
    (
        repeat_chunks(ordered)
        .select("storage_path", F.col("line").alias("value"))
        .write.mode("append")
        .partitionBy("storage_path")
        .option("compression", compression)
        .text(path)
    )


def concat_recent(
    df: DataFrame, path: str, order: Sequence[str], raw: str = "raw", compression: str = "none"
) -> None:
    """All documents of a run appended to one file per ``recent_path``.

    Bytes stay as they are, except that a document without a final newline gets
    one, so that the next document starts on its own line.
    """
    newline = F.substring(raw, -1, 1) == F.lit(b"\n")
    # on bytes: a string function would replace what is no valid UTF-8
    value = F.when(newline, F.substr(F.col(raw), F.lit(1), F.length(raw) - 1)).otherwise(F.col(raw))
    (
        recent_order(df, order)
        .select("recent_path", value.cast("string").alias("value"))
        .write.mode("append")
        .partitionBy("recent_path")
        .option("lineSep", "\n")
        .option("compression", compression)
        .text(path)
    )


def export_edges(edges: DataFrame, path: str, compression: str = "none") -> None:
    """Reference edges as one JSON array, an edge a line, sorted; parts in name order form it.

    ``edges`` has one row an edge, as a stored state has.  The comma before each edge but
    the first needs only the least one, not a number for each.
    """
    least = edges.select(F.min(F.struct("referencing", "referenced")).alias("least")).first().least
    edge = F.struct(
        "referencing", "referenced", "weight", F.unix_millis("expires_at").alias("expiresAfterMillis")
    )
    first = (F.col("referencing") == F.lit(least and least.referencing)) & (
        F.col("referenced") == F.lit(least and least.referenced)
    )
    line = F.concat(F.when(first, "").otherwise(","), F.to_json(edge))
    ordered = edges.select(F.lit(1).alias("place"), "referencing", "referenced", line.alias("line"))
    frame, none = edges.sparkSession.range(1), F.lit(None).cast("string")
    for place, bracket in ((0, "["), (2, "]")):
        end = frame.select(
            F.lit(place).alias("place"), none.alias("referencing"), none.alias("referenced"),
            F.lit(bracket).alias("line"),
        )
        ordered = ordered.unionByName(end)
    keys = ["place", "referencing", "referenced"]
    (
        ordered.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("line")
        .write.mode("overwrite")
        .option("compression", compression)
        .text(path)
    )


def export_index_json(
    index: DataFrame,
    path: str,
    created: str,
    base_url: str = "",
    compressions: Sequence[str] = ("none", "gzip", "bzip2"),
) -> None:
    """The index as one nested JSON document, plain and compressed.

    Fragments are range-sorted; parts in name order form the document.
    """
    spark = index.sparkSession
    head = F.to_json(
        F.struct(
            F.lit(created).alias("index_created"),
            F.when(F.lit(base_url) != "", F.lit(base_url)).alias("path"),
        )
    )
    frame = spark.range(1)
    tree = index_tree(index)
    comma = "," if tree.limit(1).count() else ""
    opening = frame.select(
        F.lit("").alias("sort_key"),
        F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(comma)).alias("fragment"),
    )
    closing = frame.select(F.lit("9").alias("sort_key"), F.lit("}").alias("fragment"))
    ordered = (
        tree.unionByName(opening)
        .unionByName(closing)
        .repartitionByRange("sort_key")
        .sortWithinPartitions("sort_key")
        .select("fragment")
    )
    for codec in compressions:
        ordered.write.mode("overwrite").option("compression", codec).text(f"{path}/{codec}")
