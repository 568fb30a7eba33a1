"""Secrets, state between runs, and the stored archive."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.formats import SECRET_LENGTHS
from descry.functions.text import is_hex, lines_of
from descry.operators.keys import keep_last


def read_ip_secrets(spark: SparkSession, path: str) -> DataFrame:
    """Secrets per month from ``month,hex`` lines; the last line of a month wins.

    One bad line makes the whole set unusable: nothing may be hashed with a
    secret from a damaged file.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(lines_of(F.col("value"))).alias("pos", "line")
    )
    parts = F.split("line", ",", -1)
    parsed = lines.withColumn("month", parts[0]).withColumn("hex", F.get(parts, F.lit(1)))
    valid = (
        F.col("month").rlike(r"\A\d{4}-\d{2}\z")
        & (F.size(parts) == 2)
        & is_hex(F.col("hex"))
        & (F.length("hex") / 2).isin(*SECRET_LENGTHS)
    )
    if parsed.filter(~F.coalesce(valid, F.lit(False))).limit(1).count():
        raise ValueError(f"invalid line in secrets file {path}: refusing to hash anything")
    return keep_last(parsed, ["month"], ["pos"]).select("month", F.unhex("hex").alias("secret"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one with ``schema`` when there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return spark.createDataFrame([], schema)
        raise


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of a state table; empty when there is none.

    Versions are kept side by side (see ``save_state``), so a run that dies
    while saving leaves the previous version intact.  The newest is found from the
    folders' names; no other is opened.
    """
    runs = state_versions(spark, path)
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/run={runs[-1]}")


def _hadoop_folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no such folder."""
    folder, files = _hadoop_folder(spark, path)
    if not files.exists(folder):
        return []
    return [s.getPath().getName() for s in files.listStatus(folder)]


def remove_folder(spark: SparkSession, path: str) -> None:
    folder, files = _hadoop_folder(spark, path)
    files.delete(folder, True)


def state_versions(spark: SparkSession, path: str) -> list[str]:
    """Runs that a state table has versions of, the newest last."""
    names = folder_names(spark, path)
    return sorted(n.removeprefix("run=") for n in names if n.startswith("run="))


def drop_old_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Remove all but the newest versions of a state table."""
    for run in state_versions(spark, path)[:-keep]:
        remove_folder(spark, f"{path}/run={run}")


EDGE_JSON = "struct<referencing:string,referenced:string,weight:double,expiresAfterMillis:bigint>"
EDGE_SCHEMA = "referencing string, referenced string, weight double, expires_at timestamp"


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Reference edges from a JSON array; a damaged file counts as empty.

    The array may stand in one line, or as ``export_edges`` writes it: an edge a line, over
    any number of parts.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        lines = spark.createDataFrame([], "value string")
    inside = F.regexp_extract("value", r"\A\s*[\[,]?\s*(.*?)\s*[\],]?\s*\z", 1)
    parsed = lines.select(inside.alias("inside")).filter("inside <> ''").select(
        F.from_json(F.concat(F.lit("["), "inside", F.lit("]")), f"array<{EDGE_JSON}>").alias("edges")
    )
    unread = F.col("edges").isNull() | F.exists("edges", lambda e: e["referencing"].isNull())
    if parsed.filter(unread).limit(1).count():
        return spark.createDataFrame([], EDGE_SCHEMA)
    return parsed.select(F.explode("edges").alias("e")).select(
        "e.referencing",
        F.coalesce("e.referenced", F.lit("")).alias("referenced"),
        "e.weight",
        F.timestamp_millis("e.expiresAfterMillis").alias("expires_at"),
    )


def read_archive(
    spark: SparkSession, path: str, kinds: Iterable[str] | None = None, months: Iterable[str] | None = None
) -> DataFrame:
    """Stored documents by kind and month; both are partitions, so others are not read."""
    df = spark.read.parquet(path)
    if kinds is not None:
        df = df.filter(F.col("kind").isin(*kinds))
    if months is not None:
        df = df.filter(F.col("month").isin(*months))
    return df
