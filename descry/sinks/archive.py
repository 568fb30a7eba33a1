"""The archive: documents by kind, month and part of it, the digest of their bytes beside them.

A part is small: of documents named by their content those with the same first digit, of
those named by time a day's, of votes an hour's.  What a run stores is compared with the
parts it falls in, by names and digests; stored bytes are read only of a part that is
rewritten because a document in it has other bytes now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.operators.keys import keep_last
from descry.session import checkpointed
from descry.sinks.tables import schema_of, touched_by, write_new_only, write_overwrite
from descry.sources.state import read_table

PARTITIONS = ("kind", "month", "part")
#: Documents named by their content; a name is never given to other bytes.
NAMED_BY_CONTENT = ("server", "extra-info", "microdescriptor", "bridge-server", "bridge-extra-info")
#: Documents of which an hour is a part.
LARGE_KINDS = ("vote",)


def archive_part(kind: Column, published: Column, digest: Column) -> Column:
    """The part of its month that a document is stored in, told by its name."""
    return (
        F.when(kind.isin(*NAMED_BY_CONTENT), F.lower(F.substring(digest, 1, 1)))
        .when(kind.isin(*LARGE_KINDS), F.date_format(published, "dd-HH"))
        .otherwise(F.date_format(published, "dd"))
    )


def in_parts(rows: DataFrame) -> DataFrame:
    """Rows to store, with the digest of their bytes and the part they belong to."""
    part = archive_part(F.col("kind"), F.col("published"), F.col("digest"))
    return rows.withColumn("sha1", F.sha1("raw")).withColumn("part", part)


def changed_documents(rows: DataFrame, archive: str) -> DataFrame:
    """Rows in parts that the archive lacks or has with other bytes; no stored bytes are read."""
    stored = read_table(rows.sparkSession, archive, schema_of(rows, PARTITIONS))
    name = [*PARTITIONS, "storage_path", "sha1"]
    same = touched_by(stored, rows, PARTITIONS).select(*name)
    return rows.join(same, name, "left_anti")


def store_new(rows: DataFrame, archive: str) -> DataFrame:
    """First write wins; returns the rows stored."""
    return write_new_only(in_parts(rows), archive, ["storage_path"], ["digest"], PARTITIONS)


def store_latest(rows: DataFrame, archive: str) -> DataFrame:
    """Last write wins; returns the rows whose bytes are new."""
    latest = checkpointed(keep_last(in_parts(rows), ["storage_path"], ["digest"]))
    changed = checkpointed(changed_documents(latest, archive))
    write_overwrite(changed, archive, ["storage_path"], ["digest"], PARTITIONS)
    return changed


def store_documents(rows: DataFrame, archive: str) -> DataFrame:
    """Each kind by its own rule: names of content are given once, names of a time again."""
    by_content = F.col("kind").isin(*NAMED_BY_CONTENT)
    new = store_new(rows.filter(by_content), archive)
    return new.unionByName(store_latest(rows.filter(~by_content), archive))
