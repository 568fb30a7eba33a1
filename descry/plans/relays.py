"""Relay descriptors, end to end: files to archive, then the checks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.operators.archive import with_annotation, with_archive_paths
from descry.operators.documents import (
    expected_votes,
    extract_certificates,
    microdesc_with_valid_after,
    parse_bandwidth_header,
    parse_extra_info,
    parse_microdescriptor,
    parse_server_descriptor,
    parse_status,
    split_by_kind,
    status_dir_sources,
    status_entries,
)
from descry.operators.integrity import (
    completeness,
    completeness_report,
    missing_references,
    missing_weight,
    reference_edges,
)
from descry.operators.keys import keep_first, keep_last
from descry.operators.secrets import month_of
from descry.plans.relay_state import (
    BEGINNING,
    RelayState,
    referenced_keys,
    request_batches,
    seen_keys,
)
from descry.session import checkpointed
from descry.sinks.archive import store_documents
from descry.sinks.files import export_edges
from descry.sources.files import list_descriptor_files, read_descriptor_files

ARCHIVE_COLUMNS = ("kind", "published", "digest", "storage_path", "recent_path", "raw", "month")


@dataclass(frozen=True)
class Parsed:
    """Fields of all relay documents.  None of these frames carries ``raw``."""

    statuses: DataFrame
    entries: DataFrame
    dir_sources: DataFrame
    servers: DataFrame
    extra_infos: DataFrame
    microdescs: DataFrame


def of_kind(documents: DataFrame, *kinds: str) -> DataFrame:
    return documents.filter(F.col("kind").isin(*kinds))


def parse_documents(documents: DataFrame) -> Parsed:
    """Fields of the documents, each document parsed once and its fields written."""
    statuses = checkpointed(
        parse_status(of_kind(documents, "consensus", "consensus-microdesc", "vote"))
    )
    entries = checkpointed(status_entries(statuses, ["kind", "valid_after", "fingerprint"]))
    servers = checkpointed(parse_server_descriptor(of_kind(documents, "server")))
    return Parsed(
        statuses=statuses,
        entries=entries,
        dir_sources=status_dir_sources(statuses),
        servers=servers.select("digest", "published", "fingerprint", "extra_info_digest"),
        extra_infos=parse_extra_info(of_kind(documents, "extra-info")).select(
            "digest", "published", "fingerprint"
        ),
        microdescs=parse_microdescriptor(of_kind(documents, "microdescriptor")).select(
            "sha256_hex", "sha256_b64"
        ),
    )


def archive_rows(documents: DataFrame, parsed: Parsed, received: datetime) -> DataFrame:
    """Rows to store, of all kinds, with path and annotation.

    A microdescriptor is stored once per month of a status referring to it; the
    join runs on digests and the bytes are joined back by digest.
    """
    base = ["path", "pos", "kind", "raw"]
    docs = documents.select(*base)
    statuses = parse_status(
        of_kind(docs, "consensus", "consensus-microdesc", "vote"), keep_raw=True
    ).withColumn("published", F.col("valid_after"))
    frames = [
        (k, statuses.filter(F.col("kind") == k).withColumn("digest", F.sha1("raw")))
        for k in ("consensus", "consensus-microdesc")
    ]
    # a vote's path carries its authority's identity
    votes = statuses.filter(F.col("kind") == "vote")
    frames.append(("vote", votes.withColumn("fingerprint", F.col("dir_source"))))
    frames.append(("server", parse_server_descriptor(of_kind(docs, "server"))))
    frames.append(("extra-info", parse_extra_info(of_kind(docs, "extra-info"))))
    certificates = extract_certificates(of_kind(docs, "vote")).withColumn(
        "published", F.col("key_published")
    )
    frames.append(("certificate", certificates.withColumn("digest", F.sha1("raw"))))
    bandwidth = parse_bandwidth_header(of_kind(docs, "bandwidth"), path="path").withColumn(
        "published", F.col("created")
    )
    frames.append(("bandwidth", bandwidth))
    references = microdesc_with_valid_after(
        parsed.microdescs.select("sha256_hex").distinct(), parsed.entries
    )
    micro_months = references.groupBy("sha256_hex", month_of(F.col("valid_after")).alias("__m")).agg(
        F.min("valid_after").alias("published")
    )
    micro = (
        parse_microdescriptor(of_kind(docs, "microdescriptor"))
        .join(micro_months.drop("__m"), "sha256_hex")
        .withColumn("digest", F.col("sha256_hex"))
    )
    frames.append(("microdescriptor", micro))
    result = None
    for kind, frame in frames:
        layout = "bandwidth-import" if kind == "bandwidth" else kind
        if "digest" not in frame.columns:
            frame = frame.withColumn("digest", F.sha1("raw"))
        rows = (
            with_annotation(
                with_archive_paths(
                    frame.filter(F.col("published").isNotNull()), layout, received=received
                ),
                kind,
                source="source" if kind == "bandwidth" else None,
            )
            .withColumn("kind", F.lit(kind))
            .withColumn("digest", F.coalesce("digest", F.sha1("raw")))
            .withColumn("month", month_of(F.col("published")))
            .select(*ARCHIVE_COLUMNS)
        )
        result = rows if result is None else result.unionByName(rows)
    return result


def checks(
    parsed: Parsed, now: datetime, state: RelayState | None = None
) -> tuple[DataFrame, DataFrame]:
    """Completeness per status, and the weight of missing references.

    With a state, documents stored by earlier runs are known, and their references still
    count until they expire.
    """
    servers, extra_infos, microdescs = parsed.servers, parsed.extra_infos, parsed.microdescs
    edges = reference_edges(
        parsed.statuses,
        parsed.dir_sources,
        parsed.entries,
        servers,
        extra_infos,
        microdescs,
        now,
    )
    if state is not None:
        referenced = parsed.entries.select(F.col("micro_digest").alias("sha256_hex"), "valid_after")
        timed = microdescs.join(referenced, "sha256_hex").select(
            F.col("sha256_hex").alias("digest"), "valid_after"
        )
        edges = state.remember_edges(edges, now)
        servers, extra_infos, microdescs = state.remember_documents(
            servers, extra_infos, timed, now
        )
    counts = completeness(
        parsed.entries.withColumn("fingerprint", F.coalesce("fingerprint", F.lit(""))),
        servers,
        extra_infos,
        microdescs,
    )
    report = completeness_report(
        counts,
        parsed.statuses.filter("kind = 'vote'"),
        expected_votes(parsed.dir_sources),
        parsed.statuses,
        now,
    )
    return report, missing_weight(missing_references(edges))


@dataclass(frozen=True)
class RelayRun:
    """What a run stored and found."""

    written: DataFrame
    report: DataFrame
    weight: DataFrame
    work: DataFrame
    requests: DataFrame


def store_and_parse(
    spark: SparkSession, folder: str, archive: str, now: datetime, wanted: DataFrame | None = None
) -> tuple[DataFrame, Parsed]:
    """Store all relay documents of the files ``wanted`` below a folder, and their fields."""
    files = read_descriptor_files(spark, folder, wanted=wanted)
    documents = split_by_kind(files).withColumn("__sha1", F.sha1("raw"))
    unique = checkpointed(keep_first(documents, ["__sha1"], ["path", "pos"]).drop("__sha1"))
    parsed = parse_documents(unique)
    rows = checkpointed(keep_last(archive_rows(unique, parsed, now), ["storage_path"], ["digest"]))
    return store_documents(rows, archive), parsed


def run_relays(
    spark: SparkSession, folder: str, archive: str, now: datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store all relay documents below a folder and check them, without any history.

    Returns the rows stored, the completeness report and the missing weight.
    """
    written, parsed = store_and_parse(spark, folder, archive, now)
    return written, *checks(parsed, now)


def continue_relays(
    spark: SparkSession,
    folder: str,
    archive: str,
    state: RelayState,
    now: datetime,
    edges_json: str | None = None,
) -> RelayRun:
    """Store and check what has arrived since the run before.

    Only files not read before, or written again, are opened.  Files are remembered last,
    so a run that died is repeated as a whole; what it has stored is not stored again.
    """
    listed = list_descriptor_files(spark, folder, state.files.read(spark, BEGINNING))
    new = checkpointed(listed)
    written, parsed = store_and_parse(spark, folder, archive, now, new)
    report, weight = checks(parsed, now, state)
    report, weight = checkpointed(report), checkpointed(weight)
    work = state.update_work(
        referenced_keys(parsed.entries, parsed.dir_sources, parsed.servers, now),
        seen_keys(parsed.statuses, parsed.servers, parsed.extra_infos),
        now,
        parsed.microdescs.select(F.col("sha256_hex").alias("digest")),
    )
    if edges_json:
        export_edges(state.edges.read(spark, now), edges_json)
    state.files.insert(new, BEGINNING)
    state.compact(spark)
    return RelayRun(written, report, weight, work, request_batches(work))
