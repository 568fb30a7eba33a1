"""Split, classify and parse documents.

A document is one row, so everything about one document happens inside its row
on arrays of lines: no shuffle, no window.  ``raw`` stays out of what is
exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.functions.digests import descriptor_digest
from descry.functions.text import (
    as_bytes,
    as_text,
    base64_to_hex,
    base64_unpadded,
    fields_of,
    first_body_line,
    last_line_value,
    let,
    lines_of,
    once,
    parse_time,
    sections,
    unix_lines,
)

# --- fixed values: how a document of each kind starts and ends -------------------
DOCUMENT_PATTERNS = {
    "server": r"(?dsm)^router .*?\nrouter-signature\n.*?\n-----END SIGNATURE-----\n",
    "extra-info": r"(?dsm)^extra-info .*?\nrouter-signature\n.*?\n-----END SIGNATURE-----\n",
    "vote": r"(?dsm)^network-status-version .*?(?=^network-status-version |\z)",
    "microdescriptor": r"(?dsm)^onion-key\n.*?(?=^onion-key\n|\z)",
}


def classify(text: Column) -> Column:
    """Kind of a document by its first line that is no annotation."""

    def by_first_line(first: Column) -> Column:
        return (
            F.when(
                first.startswith("network-status-version 3"),
                F.when(text.rlike(r"(?dm)^vote-status vote$"), "vote")
                .when(first == "network-status-version 3 microdesc", "consensus-microdesc")
                .otherwise("consensus"),
            )
            .when(first.startswith("router "), "server")
            .when(first.startswith("extra-info "), "extra-info")
            .when(first == "onion-key", "microdescriptor")
            .when(first.rlike(r"\A\d{10}\z"), "bandwidth")
            .when(first.rlike(r"\A(?:published |flag-thresholds |r )"), "bridge-status")
            .otherwise("unknown")
        )

    return let(first_body_line(text), by_first_line)


def classify_descriptor(df: DataFrame, raw: str = "raw", alias: str = "kind") -> DataFrame:
    return once(df, **{alias: classify(unix_lines(as_text(F.col(raw))))})


def documents_in(text: Column, kind: str) -> Column:
    """All documents of one kind in a concatenated text."""
    return F.regexp_extract_all(text, F.lit(DOCUMENT_PATTERNS[kind]), F.lit(0))


def explode_documents(df: DataFrame, found: Column, kind: Column, raw: str = "raw") -> DataFrame:
    """One row per document text in ``found``, with its position.

    The outer form keeps the optimizer from running ``found`` a second time in
    an inferred filter.
    """
    others = [c for c in df.columns if c not in (raw, "kind")]
    return (
        df.select(*others, kind.alias("kind"), F.posexplode_outer(found).alias("pos", "__text"))
        .filter(F.col("pos").isNotNull())
        .select(*others, "pos", "kind", as_bytes(F.col("__text")).alias(raw))
    )


def split_descriptors(df: DataFrame, kind: str, raw: str = "raw") -> DataFrame:
    """One row per document in a concatenated file, with its position.

    A truncated tail is dropped; votes and microdescriptors run to the next
    start or the end.
    """
    return explode_documents(df, documents_in(as_text(F.col(raw)), kind), F.lit(kind), raw)


def split_by_kind(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Documents of files that hold any kind, in one pass over the files.

    Files of descriptors are split; statuses and bandwidth files are one
    document each; files of unknown kind are dropped.
    """
    text = as_text(F.col(raw))
    found = F.when(F.col("kind") != "unknown", F.array(text))
    for kind in ("server", "extra-info", "microdescriptor"):
        found = F.when(F.col("kind") == kind, documents_in(text, kind)).otherwise(found)
    return explode_documents(classify_descriptor(files, raw), found, F.col("kind"), raw)


def split_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines of a text with their position."""
    others = [c for c in df.columns if c != text]
    lines = F.posexplode_outer(lines_of(F.col(text))).alias("pos", "line")
    return df.select(*others, lines).filter(F.col("pos").isNotNull())


# --- network statuses ----------------------------------------------------------


# --- fixed values: well-formed r lines, and malformed m lines ----------------------
_GOOD_R = r"(?d)\Ar(?: [^ \n]*){7,8} *(?:\n|\z)"
_BAD_M = r"(?dm)^m (?![^ \n]{43} *$|[^ \n]* sha256=[^ \n]{43} *$)"
_M_DIGEST = r"(?dm)^m ([^ \n]{43}) *$"


def _entries_before_first_bad(parts: Column) -> Column:
    """Entry texts up to the first malformed line, as far as they are usable."""
    bad = F.transform(parts, lambda p: ~p.rlike(_GOOD_R) | p.rlike(_BAD_M))

    def usable(k: Column) -> Column:
        broken = F.get(parts, k - 1)
        rest = F.when(
            broken.rlike(_GOOD_R), F.array(F.regexp_replace(broken, "(?s)" + _BAD_M + r".*\z", ""))
        ).otherwise(F.slice(parts, 1, 0))
        return F.when(k == 0, parts).otherwise(F.concat(F.slice(parts, 1, k - 1), rest))

    return let(F.array_position(bad, True).cast("int"), usable)


def parse_status(df: DataFrame, raw: str = "raw", keep_raw: bool = False) -> DataFrame:
    """Header fields of statuses, with ``dir_sources`` and the texts of ``entries``.

    ``df`` holds consensuses and votes only.  The text is cut before each ``r``
    line: the first part is the header, each other part one entry.  Parsing
    stops at the first malformed r or m line.  Entries stay text here: their
    fields are read after exploding, in generated code.  With ``keep_raw`` the
    document stays with its header, for storing it without a join.
    """
    text = unix_lines(as_text(F.col(raw)))
    header = F.col("__parts")[0]
    sources = F.transform(
        F.filter(
            sections(header, "dir-source "),
            lambda p: p.startswith("dir-source ") & p.contains("\nvote-digest "),
        ),
        lambda p: F.regexp_extract(p, r"(?d)\Adir-source \S+ (\S+)", 1),
    )
    dropped = ("kind", "digest") if keep_raw else (raw, "kind", "digest")
    keep = [c for c in df.columns if c not in dropped]
    kind = F.col("kind") if "kind" in df.columns else classify(F.col("__text"))
    header_and_entries = (
        df.withColumn("__text", text)
        .withColumn("kind", kind)
        .withColumn("__parts", sections(F.col("__text"), "r "))
        .withColumn("__entries", F.slice("__parts", 2, F.size("__parts")))
    )
    # plain columns, so that readers of few of them do not pay for the rest
    return header_and_entries.select(
        *keep,
        "kind",
        parse_time(last_line_value(header, "valid-after")).alias("valid_after"),
        F.get(fields_of(last_line_value(header, "fingerprint")), F.lit(0)).alias("fingerprint"),
        F.regexp_extract(
            F.coalesce(last_line_value(header, "dir-source"), F.lit("")), r"\A\S+ (\S+)", 1
        ).alias("dir_source"),
        F.when(F.col("kind") == "vote", descriptor_digest(F.col(raw), "vote")).alias("digest"),
        parse_time(last_line_value(header, "dir-key-published")).alias("key_published"),
        F.array_sort(F.array_distinct(sources)).alias("dir_sources"),
        _entries_before_first_bad(F.col("__entries")).alias("entries"),
    )


def status_entries(statuses: DataFrame, keys: Sequence[str] = ("kind", "valid_after")) -> DataFrame:
    """One row per entry and microdescriptor digest (or one without a digest).

    A full ``r`` line has nine fields; that of a microdescriptor consensus lacks the
    server digest, so its time stands one field earlier.  ``n_entries`` counts the
    status's entries, however many digests each has.
    """
    f = F.col("__f")
    exploded = (
        statuses.select(
            *keys, F.size("entries").alias("n_entries"), F.explode_outer("entries").alias("__e")
        )
        .filter(F.col("__e").isNotNull())
        .withColumn("__f", fields_of(F.substring_index("__e", "\n", 1)))
        .withColumn("__m", F.regexp_extract_all("__e", F.lit(_M_DIGEST), F.lit(1)))
    )
    full = F.size(f) == 9
    at = F.when(full, F.lit(4)).when(F.size(f) == 8, F.lit(3))
    time = parse_time(F.concat_ws(" ", F.get(f, at), F.get(f, at + 1)))
    return exploded.select(
        *keys,
        "n_entries",
        base64_to_hex(f[2]).alias("relay_identity"),
        F.when(full, base64_to_hex(f[3])).alias("server_digest"),
        F.when(at.isNotNull(), time).alias("published"),
        F.explode_outer("__m").alias("__m"),
    ).select(
        *keys, "n_entries", "relay_identity", "server_digest", "published", base64_to_hex(F.col("__m")).alias("micro_digest")
    )


def status_dir_sources(statuses: DataFrame) -> DataFrame:
    return statuses.select(
        "kind", "valid_after", F.explode_outer("dir_sources").alias("identity")
    ).filter(F.col("identity").isNotNull())


def expected_votes(dir_sources: DataFrame) -> DataFrame:
    """Authorities with a vote digest per consensus."""
    return (
        dir_sources.filter(F.col("kind") == "consensus")
        .groupBy("valid_after")
        .agg(F.count_distinct("identity").alias("expected_votes"))
    )


def extract_certificates(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Key certificates in votes: up to the first ``r`` line, none without one."""
    text = unix_lines(as_text(F.col(raw)))
    cert = F.regexp_extract(text, r"(?dms)^(dir-key-certificate-version .*?)^r ", 1)
    others = [c for c in df.columns if c != raw]
    source = F.coalesce(last_line_value(text, "dir-source"), F.lit(""))
    return (
        once(df, __cert=cert)
        .filter(F.col("__cert") != "")
        .select(
            *others,
            F.regexp_extract(source, r"\A\S+ (\S+)", 1).alias("fingerprint"),
            parse_time(last_line_value(text, "dir-key-published")).alias("key_published"),
            as_bytes(F.col("__cert")).alias(raw),
        )
    )


# --- descriptors -----------------------------------------------------------------


def parse_server_descriptor(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Digest, time, fingerprint and extra-info digest; rows without a signed part dropped."""
    text = unix_lines(as_text(F.col(raw)))
    fingerprint = last_line_value(text, "(?:opt )?fingerprint")
    extra = F.get(fields_of(last_line_value(text, "(?:opt )?extra-info-digest")), F.lit(0))
    return (
        once(df, digest=descriptor_digest(F.col(raw), "server"))
        .filter(F.col("digest").isNotNull())
        .withColumn("published", parse_time(last_line_value(text, "published")))
        .withColumn("fingerprint", F.lower(F.replace(fingerprint, F.lit(" "), F.lit(""))))
        .withColumn("extra_info_digest", F.lower(extra))
    )


def parse_extra_info(df: DataFrame, raw: str = "raw") -> DataFrame:
    text = unix_lines(as_text(F.col(raw)))
    return (
        once(df, digest=descriptor_digest(F.col(raw), "extra-info"))
        .filter(F.col("digest").isNotNull())
        .withColumn("published", parse_time(last_line_value(text, "published")))
        .withColumn("fingerprint", F.lower(F.get(fields_of(first_body_line(text)), F.lit(2))))
    )


def parse_microdescriptor(df: DataFrame, raw: str = "raw") -> DataFrame:
    return once(df, sha256_hex=F.sha2(raw, 256)).withColumn(
        "sha256_b64", base64_unpadded(F.unhex("sha256_hex"))
    )


def parse_bandwidth_header(
    df: DataFrame, raw: str = "raw", path: str | None = None
) -> DataFrame:
    """Creation time and source (parent folder) of bandwidth files."""
    text = unix_lines(as_text(F.col(raw)))
    header = F.regexp_extract(
        text, r"(?dms)\A(?:@[^\n]*\n)*(.*?)(?=^bw=|^[^\n]* bw=|^={4,5}$|\z)", 1
    )
    stated = F.regexp_extract(header, r"(?dm)^file_created=(.*)$", 1)
    created = F.coalesce(
        F.try_to_timestamp(stated, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.timestamp_seconds(first_body_line(text).try_cast("long")),
        F.lit("2000-01-01 00:00:00").cast("timestamp"),
    )
    source = F.try_element_at(F.split(path, "/"), F.lit(-2)) if path else F.lit(None).cast("string")
    return (
        df.withColumn("created", created)
        .withColumn("source", source)
        .withColumn("digest", F.upper(descriptor_digest(F.col(raw), "bandwidth-import")))
    )


# --- fixed values: the line that carries the time, with the kinds that use it -----
TIME_LINES = {
    "published": ("bridge-extra-info", "bridge-server", "bridge-status", "extra-info", "server"),
    "valid-after": ("consensus", "consensus-microdesc", "vote"),
    "dir-key-published": ("certificate",),
    "Downloaded": ("exit-list",),
    "bridge-pool-assignment": ("pool-assignment",),
    "snowflake-stats-end": ("proxy-stats",),
    "bridgedb-metrics-end": ("distributor-metrics",),
}


def document_time(kind: Column, text: Column) -> Column:
    """Publication time of a document; microdescriptors have none.

    A trailing interval such as ``(86400 s)`` after the time is ignored.
    """
    start = F.regexp_extract(text, r"(?:\A| )START=(\d+)(?:\.\d+)?", 1).try_cast("long")
    created = F.regexp_extract(text, r"(?dm)^file_created=(.*)$", 1)
    epoch = first_body_line(text).try_cast("long")
    case = F.when(kind == "transfer", F.timestamp_seconds(start)).when(
        kind == "bandwidth",
        F.coalesce(
            F.try_to_timestamp(created, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.timestamp_seconds(epoch)
        ),
    )
    for keyword, kinds in TIME_LINES.items():
        value = F.regexp_extract(text, rf"(?dm)^{keyword} (\S+ \S+)", 1)
        case = case.when(kind.isin(*kinds), parse_time(value))
    return case


def descriptor_time(
    df: DataFrame, kind: str = "kind", raw: str = "raw", alias: str = "published"
) -> DataFrame:
    return once(df, **{alias: document_time(F.col(kind), unix_lines(as_text(F.col(raw))))})


def microdesc_with_valid_after(micro: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per microdescriptor and month of a status that refers to it.

    Microdescriptors nobody refers to are dropped.  References are made distinct
    before the join, so fan-out is bounded by statuses, not by entries.
    """
    references = (
        entries.filter(F.col("micro_digest").isNotNull())
        .select(F.col("micro_digest").alias("sha256_hex"), "valid_after")
        .distinct()
    )
    return micro.join(references, "sha256_hex")
