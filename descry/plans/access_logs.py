"""Access logs, end to end: files to counts to stored days."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.operators.access_logs import (
    HOSTS,
    count_sanitized_lines,
    dates_not_stored,
    merge_line_counts,
    parse_access_log,
    safe_dates,
    sanitize_access_log,
)
from descry.operators.keys import merge_counts, skip_processed
from descry.session import checkpointed
from descry.sinks.tables import save_state
from descry.sources.files import (
    is_packed,
    list_logs,
    log_slices,
    read_log_rows,
    seam_lines,
    sound_files,
)
from descry.sources.state import read_state, read_table

STAGING_SCHEMA = (
    "path string, virtual_host string, physical_host string, line string, n bigint, "
    "log_date date, run string"
)
#: Columns of the rows that tell of a part's end.
END = ("part", "ended", "seam")
ARCHIVE_SCHEMA = "virtual_host string, physical_host string, line string, n bigint, log_date date"
STATE_SCHEMA = "path string"


@dataclass(frozen=True)
class LogTables:
    """Where the job keeps counts not yet stored, stored days and its state."""

    staging: str
    archive: str
    state: str


def lines_to_counts(lines: DataFrame, *extra_keys: str) -> DataFrame:
    """Parse, sanitize and count lines that carry their hosts."""
    sanitized = sanitize_access_log(parse_access_log(lines))
    return count_sanitized_lines(sanitized, [*extra_keys, *HOSTS, "log_date", "line"])


def days_to_store(counts: DataFrame, archive: DataFrame, limits: bool) -> DataFrame:
    """Counts of days that are safe and not stored yet, added over their files."""
    days = dates_not_stored(safe_dates(counts, limits), archive)
    keys = [*HOSTS, "log_date"]
    return merge_line_counts([counts.join(days, keys, "left_semi")])


def stage_logs(files: DataFrame, tables: LogTables, label: str, **options: int) -> None:
    """Count the lines of log files into staging, one slice of files after the other.

    A slice is unpacked and counted in one pass; the rows that tell of a part's end go
    through the count beside the lines.  Only then it is known which files are sound: the
    counts of others are dropped, and lines that lie across two parts of a file are added.
    A run is overwritten when it is repeated.  Each sound file also leaves a row without a
    line, so that what has been read is known; a damaged file leaves nothing.  ``options``
    are those of the reader, such as the least size of a part.
    """
    spark = files.sparkSession
    for number, (paths, named) in enumerate(log_slices(files)):
        # one slice of names at most
        hosts = F.broadcast(named)
        rows = read_log_rows(spark, paths, **options).join(hosts, "path")
        counted = checkpointed(lines_to_counts(rows, "path", *END))
        ends = counted.filter("ended IS NOT NULL").select("path", *END)
        plain = spark.createDataFrame([(p,) for p in paths if not is_packed(p)], "path string")
        sound = F.broadcast(sound_files(ends).unionByName(plain))
        seams = lines_to_counts(seam_lines(ends).join(hosts, "path"), "path")
        keys = ["path", *HOSTS, "line", "log_date"]
        counts = merge_counts([counted.filter("ended IS NULL"), seams], keys)
        marks = named.join(sound, "path", "left_semi").select(
            "path",
            *HOSTS,
            F.lit(None).cast("string").alias("line"),
            F.lit(0).cast("long").alias("n"),
            F.lit(None).cast("date").alias("log_date"),
        )
        (
            counts.join(sound, "path", "left_semi")
            .unionByName(marks)
            .withColumn("run", F.lit(f"{label}-{number:06d}"))
            .hint("rebalance", "log_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run", "log_date")
            .parquet(tables.staging)
        )


def staged_runs(spark: SparkSession, tables: LogTables) -> DataFrame:
    """(path, run): the files read so far, each with the last run that read it."""
    staged = read_table(spark, tables.staging, STAGING_SCHEMA)
    return staged.filter("line IS NULL").groupBy("path").agg(F.max("run").alias("run"))


def store_staged(
    spark: SparkSession, tables: LogTables, files: DataFrame, limits: bool = True
) -> DataFrame:
    """Store what is safe of the counts of ``files`` (path), however they were staged.

    Days are decided once, over all of these files.  Lines that arrive late for a stored
    day stay in staging and change nothing.
    """
    archive = read_table(spark, tables.archive, ARCHIVE_SCHEMA)
    staged = read_table(spark, tables.staging, STAGING_SCHEMA).filter("line IS NOT NULL")
    chosen = staged_runs(spark, tables).join(files.select("path"), "path", "left_semi")
    counts = staged.join(chosen, ["path", "run"], "left_semi")
    # cut before the append: the archive read here is the one written to
    stored = checkpointed(days_to_store(counts, archive, limits))
    stored.hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(
        tables.archive
    )
    return stored


def run_access_logs(
    spark: SparkSession, folder: str, tables: LogTables, now: datetime, limits: bool = True
) -> DataFrame:
    """Read new log files, add their counts to staging, store what is safe.

    Counts stay in staging per file, so a file holding a date that becomes safe later is
    never read again.  Only files present now take part in the decision, whatever the age
    of their dates.  Damaged files are tried again in each run.
    """
    files = checkpointed(list_logs(spark, folder).select("path", *HOSTS, "file_date"))
    processed = staged_runs(spark, tables).select("path").unionByName(
        read_state(spark, tables.state, STATE_SCHEMA)
    )
    stage_logs(
        skip_processed(files, processed, ["path"]), tables, now.strftime("job-%Y%m%d%H%M%S")
    )
    stored = store_staged(spark, tables, files, limits)
    done = files.join(staged_runs(spark, tables), "path", "left_semi").select("path")
    save_state(done, tables.state, now)
    return stored
