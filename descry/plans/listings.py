"""Lists, timings and statistics, end to end: landed files to archived documents.

Six kinds of files take one course.  Files not read before are opened, a slice of names at a
time; each becomes documents or is rejected with a reason; documents get their annotation and
path and are stored by the kind's rule; at last the files are remembered, so a run that died
is repeated as a whole and stores nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.formats import (
    ANNOTATIONS,
    DISTRIBUTOR_METRICS_END,
    KEEP_RECENT,
    POOL_HEADER,
    PROXY_STATS_END,
)
from descry.functions.scrub import hash_fingerprint
from descry.functions.text import as_bytes, as_text, is_hex, last_per_key, lines_of, once, unix_lines
from descry.operators.archive import with_annotation, with_archive_paths
from descry.operators.freshness import latest_and_stale
from descry.operators.keys import keep_first, keep_last, skip_processed
from descry.operators.secrets import month_of
from descry.plans.relay_state import BEGINNING
from descry.session import checkpointed, scratch_path
from descry.sinks.archive import store_latest, store_new
from descry.sinks.buckets import BucketedState
from descry.sinks.files import concat_recent
from descry.sources.files import FILE_SCHEMA, binary_of, list_files, path_slices
from descry.sources.listings import (
    analysis_name,
    analysis_transfers,
    annotated_exit_list,
    download_time,
    is_exit_list,
    parse_pool_assignments,
    scan_times,
    split_statistics,
    timing_fields,
    timing_pairs,
    tpf_name,
    unpack_analyses,
)
from descry.sources.state import folder_names, read_table, remove_folder

ARCHIVE_COLUMNS = ("kind", "published", "digest", "storage_path", "recent_path", "raw", "month")
OUTCOMES = (
    "path string, pos int, kind string, published timestamp, latest timestamp, "
    "storage_path string, reason string"
)
#: Kinds whose latest time tells that something is wrong when it is long past.
WATCHED = ("pool-assignment", "exit-list", "proxy-stats")
NOTHING = "no document in it"


def text_of_file() -> Column:
    return unix_lines(as_text(F.col("content")))


# --- documents of files: each frame has a reason where a row is to be rejected ------------


def pool_documents(texts: DataFrame) -> DataFrame:
    """Sanitized assignments (path, published, raw, reason) of texts, a document a group.

    Lines are sorted by the hashed fingerprint.  A fingerprint that is no hex rejects its
    group; of two spellings of one fingerprint the later one counts.  A text whose first line
    is no header, and a group without a line, give no row.
    """
    hashed = F.lower(hash_fingerprint(F.col("fingerprint"))).alias("hashed")
    groups = (
        parse_pool_assignments(texts)
        .groupBy("path", "published")
        .agg(
            F.collect_list(F.struct(hashed, "fingerprint", "details")).alias("lines"),
            F.bool_or(~is_hex(F.col("fingerprint"))).alias("bad"),
        )
    )
    line = lambda x: F.concat(x["hashed"], F.lit(" "), x["details"], F.lit("\n"))
    head = F.lit(f"@type {ANNOTATIONS['pool-assignment']}\n{POOL_HEADER}")
    time = F.date_format("published", "yyyy-MM-dd HH:mm:ss")
    body = F.array_join(F.transform(last_per_key(F.col("lines"), "hashed"), line), "")
    return groups.select(
        "path",
        "published",
        F.when(~F.col("bad"), as_bytes(F.concat(head, time, F.lit("\n"), body))).alias("raw"),
        F.when(F.col("bad"), "fingerprint is no hex").alias("reason"),
    )


def exit_list_documents(texts: DataFrame, arrived: str = "modificationTime") -> DataFrame:
    """Exit lists (path, published, latest, raw, reason); ``latest`` is a list's last scan.

    A list without annotation gets one, with the time it arrived.  A text that is more or
    less than one list is rejected.
    """
    made = once(texts, text=annotated_exit_list(F.col("text"), F.col(arrived)))
    text = F.col("text")
    return made.select(
        "path",
        download_time(text).alias("published"),
        F.array_max(scan_times(text)).alias("latest"),
        as_bytes(text).alias("raw"),
        F.when(~is_exit_list(text), "not one exit list")
        .when(download_time(text).isNull(), "no time of download")
        .alias("reason"),
    )


def timing_documents(files: DataFrame) -> DataFrame:
    """Files of timings (path, published, source, size, raw, reason), bytes as they are.

    Every row must agree with the file's name in source, size and date.
    """
    source, size, date = tpf_name(F.col("path"))

    def differs(kv: Column) -> Column:
        own_source, own_size, start = timing_fields(kv)
        return (
            ~own_source.eqNullSafe(F.col("source"))
            | ~own_size.eqNullSafe(F.col("size"))
            | ~F.to_date(start).eqNullSafe(F.col("date"))
        )

    lines = F.filter(lines_of(text_of_file()), lambda x: (x != "") & ~x.startswith("@"))
    named = once(files, source=source, size=size, date=date, lines=lines)
    pairs = F.transform("lines", timing_pairs)
    return named.select(
        "path",
        F.col("date").cast("timestamp").alias("published"),
        "source",
        "size",
        F.col("content").alias("raw"),
        F.when(F.col("size").isNull() | F.col("date").isNull(), "invalid file name")
        .when(F.size("lines") == 0, "no timings")
        .when(F.exists("lines", lambda x: ~x.contains("=")), "other than timings")
        .when(F.exists(pairs, differs), "differs from file name")
        .alias("reason"),
    )


def analysis_documents(unpacked: DataFrame) -> DataFrame:
    """Files of analyses (path, published, source, raw, n_transfers, reason), bytes as they are.

    ``unpacked`` has path, content, text and error; every transfer must be of the file's
    source.  A file that can't be unpacked, or is no analysis, is rejected too.
    """
    source, date = analysis_name(F.col("path"))
    found = once(
        unpacked,
        source=source,
        date=date,
        by_source=F.map_entries(analysis_transfers(F.col("text"))),
    )
    transfers = lambda e: F.coalesce(F.size(e["value"]["tgen"]["transfers"]), F.lit(0))
    count = F.aggregate("by_source", F.lit(0), lambda n, e: n + F.greatest(transfers(e), F.lit(0)))
    foreign = F.exists("by_source", lambda e: (e["key"] != F.col("source")) & (transfers(e) > 0))
    return found.select(
        "path",
        F.col("date").cast("timestamp").alias("published"),
        "source",
        F.col("content").alias("raw"),
        F.coalesce(count, F.lit(0)).alias("n_transfers"),
        F.when(F.col("date").isNull(), "invalid file name")
        .when(F.col("error").isNotNull() | F.col("text").isNull(), "unreadable")
        .when(F.col("by_source").isNull(), "no analysis")
        .when(foreign, "transfer of another source")
        .alias("reason"),
    )


def statistics_documents(texts: DataFrame, end_line: str) -> DataFrame:
    """Statistics (path, pos, published, raw, reason) of texts with any number of them."""
    parts = split_statistics(texts, end_line, "published")
    return parts.select(
        "path",
        "pos",
        "published",
        as_bytes(F.col("raw")).alias("raw"),
        F.when(~F.col("good"), "no statistics").alias("reason"),
    )


# --- the jobs -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Listing:
    """Files of one kind: their names, their documents, and which document of a name stays."""

    kind: str
    documents: Callable[[DataFrame], DataFrame]
    glob: str | None = None
    first_wins: bool = True
    readable: bool = True


def _texts(files: DataFrame) -> DataFrame:
    return files.select("path", "modificationTime", text_of_file().alias("text"))


POOL_ASSIGNMENTS = Listing(
    "pool-assignment", lambda files: pool_documents(_texts(files)), "assignments.log*"
)
EXIT_LISTS = Listing(
    "exit-list", lambda files: exit_list_documents(_texts(files)), first_wins=False
)
TIMINGS = Listing("transfer", timing_documents, "*.tpf", first_wins=False)
ANALYSES = Listing(
    "transfer-analysis",
    lambda files: analysis_documents(unpack_analyses(files)),
    "*.analysis.json.xz",
    first_wins=False,
    readable=False,
)
PROXY_STATISTICS = Listing(
    "proxy-stats", lambda files: statistics_documents(_texts(files), PROXY_STATS_END)
)
DISTRIBUTOR_METRICS = Listing(
    "distributor-metrics", lambda files: statistics_documents(_texts(files), DISTRIBUTOR_METRICS_END)
)
LISTINGS = (
    POOL_ASSIGNMENTS, EXIT_LISTS, TIMINGS, ANALYSES, PROXY_STATISTICS, DISTRIBUTOR_METRICS
)


@dataclass(frozen=True)
class ListingRun:
    """Documents stored (without their bytes), what was rejected, and how late the kind is."""

    written: DataFrame
    rejects: DataFrame
    freshness: DataFrame


def listing_outcomes(listing: Listing, files: DataFrame, now: datetime) -> DataFrame:
    """Documents of files (path, modificationTime, content) ready to store, and rejected ones."""
    found = listing.documents(files)
    if "pos" not in found.columns:
        found = found.withColumn("pos", F.lit(0))
    if "latest" not in found.columns:
        found = found.withColumn("latest", F.col("published"))
    pathed = with_archive_paths(found, listing.kind, received=now)
    if listing.kind in ANNOTATIONS and listing.kind != "transfer":
        pathed = with_annotation(pathed, listing.kind)
    good = F.col("reason").isNull()
    columns = ["path", "pos", "latest", "reason", *ARCHIVE_COLUMNS]
    return (
        pathed.withColumn("kind", F.lit(listing.kind))
        .withColumn("storage_path", F.when(good, F.col("storage_path")))
        .withColumn("digest", F.sha1("raw"))
        .withColumn("month", month_of(F.col("published")))
        .select(*columns)
    )


def run_listing(
    spark: SparkSession,
    listing: Listing,
    folder: str,
    archive: str,
    state: str,
    now: datetime,
    recent: str | None = None,
) -> ListingRun:
    """Store the documents of a kind's files that have arrived since the run before.

    Documents of a name are kept first or last by the kind's rule, files in order of their
    paths.  With ``recent``, what was stored is also written there as text files in a folder
    for the day of the run, and folders older than three days are removed.  A file without
    any document is rejected; an empty file is left for a later run.
    """
    known = BucketedState(
        f"{state}/{listing.kind}", FILE_SCHEMA, ("path", "modificationTime"), "modificationTime", True
    )
    listed = skip_processed(
        list_files(spark, folder, listing.glob), known.read(spark, BEGINNING), known.keys
    )
    new = checkpointed(listed)
    scratch = scratch_path(spark, "listing")
    keep = keep_first if listing.first_wins else keep_last
    store = store_new if listing.first_wins else store_latest
    names = ["kind", "published", "digest", "storage_path", "recent_path"]
    for paths in path_slices(new):
        outcomes = checkpointed(listing_outcomes(listing, binary_of(spark, paths), now))
        rows = keep(outcomes.filter("reason IS NULL"), ["storage_path"], ["path", "pos"])
        written = store(rows.select(*ARCHIVE_COLUMNS), archive)
        if recent and listing.readable:
            concat_recent(written, f"{recent}/{_day(now)}", ["storage_path"])
        written.select(*names).write.mode("append").parquet(f"{scratch}/written")
        told = outcomes.select(
            "path", "pos", "kind", "published", "latest", "storage_path", "reason"
        )
        told.write.mode("append").parquet(f"{scratch}/outcomes")
    outcomes = read_table(spark, f"{scratch}/outcomes", OUTCOMES)
    empty = skip_processed(new.select("path"), outcomes, ["path"]).select(
        "path", F.lit(0).alias("pos"), F.lit(NOTHING).alias("reason")
    )
    rejects = outcomes.filter("reason IS NOT NULL").select("path", "pos", "reason").unionByName(empty)
    watched = outcomes.filter("reason IS NULL").filter(F.col("kind").isin(*WATCHED))
    if recent:
        drop_recent(spark, recent, now)
    known.insert(new, BEGINNING)
    known.compact(spark)
    schema = "kind string, published timestamp, digest string, storage_path string, recent_path string"
    return ListingRun(
        read_table(spark, f"{scratch}/written", schema),
        rejects,
        latest_and_stale(watched, now, time_col="latest"),
    )


_DAY = "arrived="


def _day(time: datetime) -> str:
    return f"{_DAY}{time:%Y-%m-%d}"


def drop_recent(spark: SparkSession, recent: str, now: datetime) -> list[str]:
    """Remove the folders of recent files whose day is over for three days; returns them."""
    last = _day(now - KEEP_RECENT)
    gone = sorted(n for n in folder_names(spark, recent) if n.startswith(_DAY) and n < last)
    for name in gone:
        remove_folder(spark, f"{recent}/{name}")
    return gone
