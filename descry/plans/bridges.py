"""Bridge tarballs, end to end: members to sanitized documents in the archive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.functions.text import as_text, last_line_value, once, parse_time, unix_lines
from descry.operators.archive import with_archive_paths
from descry.operators.keys import accumulate, keep_first
from descry.operators.sanitize import (
    sanitize_extra_info,
    sanitize_network_status,
    sanitize_server_descriptor,
)
from descry.operators.secrets import ensure_secrets, month_of, with_all_secrets, with_month_secret
from descry.session import checkpointed
from descry.sinks.archive import store_new
from descry.sinks.tables import save_state
from descry.operators.documents import split_by_kind
from descry.sources.files import read_tarballs
from descry.sources.state import read_state

ARCHIVE_COLUMNS = ("kind", "published", "digest", "storage_path", "recent_path", "raw", "month")


def bridge_documents(members: DataFrame) -> DataFrame:
    """Single documents of tarball members, each content once.

    What a status becomes depends on its tarball too, so equal statuses of
    different tarballs both stay.
    """
    status = F.col("kind") == "bridge-status"
    documents = split_by_kind(members).withColumn("__sha1", F.sha1("raw")).withColumn(
        "__from", F.when(status, F.concat("authority", "default_published")).otherwise("")
    )
    kept = keep_first(documents, ["__sha1", "__from"], ["tarball", "member", "pos"])
    return kept.drop("__sha1", "__from")


#: No document is older; a later month than the run's own is not believed either.
FIRST_MONTH = "2007-01"


def named_months() -> Column:
    """Months whose secrets sanitizing a document will ask for, as it names them."""
    text = unix_lines(as_text(F.col("raw")))
    own = F.coalesce(last_line_value(text, "published"), F.col("default_published"))
    entry_times = F.regexp_extract_all(
        text, F.lit(r"(?dm)^r \S+ \S+ \S+ (\d{4}-\d{2})-\d{2} "), F.lit(1)
    )
    months = F.array_union(F.array(F.substring(own, 1, 7)), entry_times)
    return F.filter(months, lambda m: m.rlike(r"\A\d{4}-\d{2}\z"))


def by_believable_months(documents: DataFrame, now: datetime) -> DataFrame:
    """Documents with ``believable``: none of their months is outside the stated range.

    What is left needs at most one secret for each month of the range, whatever the
    documents claim.
    """
    last = now.strftime("%Y-%m")
    asked = F.col("kind").isin("server", "bridge-status")
    outside = F.exists(named_months(), lambda m: (m < FIRST_MONTH) | (m > last))
    return once(documents, believable=~asked | ~F.coalesce(outside, F.lit(False)))


def published_months(documents: DataFrame) -> DataFrame:
    """Months whose secrets sanitizing will ask for."""
    asked = documents.filter(F.col("kind").isin("server", "bridge-status"))
    return asked.select(F.explode(named_months()).alias("month")).distinct()


def sanitize_bridge_documents(
    documents: DataFrame, secrets: DataFrame | None = None, received: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sanitized documents ready to store, and rejects with their reason."""
    base = ["tarball", "member", "pos"]
    servers = documents.filter(F.col("kind") == "server").select(*base, "raw")
    extras = documents.filter(F.col("kind") == "extra-info").select(*base, "raw")
    statuses = documents.filter(F.col("kind") == "bridge-status").select(
        *base, "authority", "default_published", "raw"
    )
    if secrets is not None:
        text = unix_lines(as_text(F.col("raw")))
        timed = servers.withColumn("__time", parse_time(last_line_value(text, "published")))
        servers = with_month_secret(timed, secrets, "__time").drop("__time")
        statuses = with_all_secrets(statuses, secrets)
        clean_servers = sanitize_server_descriptor(servers, secret="secret").drop("secret")
        clean_statuses = sanitize_network_status(statuses, secrets="secrets").drop("secrets")
    else:
        clean_servers = sanitize_server_descriptor(servers)
        clean_statuses = sanitize_network_status(statuses)
    parts = [
        ("bridge-server", clean_servers),
        ("bridge-extra-info", sanitize_extra_info(extras)),
        (
            "bridge-status",
            clean_statuses.withColumn("fingerprint", F.col("authority")).withColumn(
                "digest", F.sha1("sanitized")
            ),
        ),
    ]
    stored, rejected = [], []
    for kind, frame in parts:
        timed = frame.withColumn("published", parse_time(F.col("published"))).withColumn(
            "kind", F.lit(kind)
        )
        pathed = with_archive_paths(
            timed.filter(F.col("sanitized").isNotNull()), kind, received=received
        )
        stored.append(
            pathed.withColumn("month", month_of(F.col("published")))
            .withColumnRenamed("sanitized", "raw")
            .select(*base, *ARCHIVE_COLUMNS)
        )
        rejected.append(
            timed.filter(F.col("sanitized").isNull()).select(*base, "kind", "reject_reason")
        )
    good, bad = stored[0], rejected[0]
    for g, b in zip(stored[1:], rejected[1:]):
        good, bad = good.unionByName(g), bad.unionByName(b)
    return good, bad


def run_bridges(
    spark: SparkSession,
    folder: str,
    archive: str,
    state: str,
    now: datetime,
    secrets: DataFrame | None = None,
    cutoff: datetime | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Sanitize new tarballs into the archive.

    Returns the rows stored, the rejects, and the secrets to persist.  Pass
    ``secrets`` (possibly empty) to hash addresses; persist the returned ones
    before using the stored rows.
    """
    schema = "tarball string"
    processed = read_state(spark, state, schema)
    # unpacking and splitting are the costly parts, and several readers follow
    members = checkpointed(read_tarballs(spark, folder, processed))
    whole = F.col("member").isNull()
    documents = checkpointed(bridge_documents(members.filter(~whole)))
    persist, unbelievable = None, None
    if secrets is not None:
        documents = checkpointed(by_believable_months(documents, now))
        unbelievable = documents.filter("NOT believable").select(
            "tarball", "member", "pos", "kind", F.lit("month out of range").alias("reject_reason")
        )
        documents = documents.filter("believable").drop("believable")
        everything, persist = ensure_secrets(published_months(documents), secrets, cutoff)
        secrets, persist = checkpointed(everything), checkpointed(persist)
    good, bad = sanitize_bridge_documents(documents, secrets, now)
    if unbelievable is not None:
        bad = bad.unionByName(unbelievable)
    written = store_new(good.select(*ARCHIVE_COLUMNS), archive)
    seen = members.filter(whole).select("tarball")
    save_state(accumulate(processed, seen, ["tarball"]), state, now)
    return written, bad, persist
