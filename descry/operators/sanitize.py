"""Remove or pseudonymise what could identify a bridge.

Fail closed: a line that is not known to be harmless rejects its document, with
a reason.  Each document is handled inside its row; a month's secret comes in
as a column (see ``secrets``), and hashing is off when there is none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.formats import (
    ANNOTATIONS,
    CRYPTO_BLOCK_STARTS,
    EXTRA_INFO_KEPT_LINES,
    SERVER_KEPT_LINES,
    STALE_ENTRIES_AFTER,
)
from descry.functions.digests import double_digest, double_digest_sha256
from descry.functions.scrub import (
    grouped_by_four,
    hash_base64_sha1,
    hash_base64_sha256,
    hash_fingerprint,
    master_key_from_cert,
    scrub_ipv4,
    scrub_or_address,
    scrub_tcp_port,
)
from descry.functions.text import (
    as_bytes,
    as_text,
    base64_to_hex,
    fields_of,
    is_base64,
    is_hex,
    last_line_value,
    last_per_key,
    let,
    lines_of,
    once,
    sections,
    unix_lines,
)
from descry.functions.times import span
from descry.operators.keys import without_groups

_IDENTITY_BLOCK = r"^(identity-ed25519\n)(.*?)(?:^-----END ED25519 CERT-----$\n?|\z)"
_CRYPTO_BLOCK = rf"^(?:{CRYPTO_BLOCK_STARTS})(?:\n|\z)(?:.*?)(?:^-----END [^\n]*(?:\n|\z)|\z)"
_AFTER_SIGNATURE = r"(?dms)^router-signature.*\z"

# A line's verdict: its first character tells kept (+), dropped (-), rejecting (!).


def _keep(*parts: Column | str) -> Column:
    return F.concat(F.lit("+"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _drop() -> Column:
    return F.lit("-")


def _reject(reason: str) -> Column:
    return F.lit("!" + reason)


def _or_reject(value: Column, reason: str) -> Column:
    return F.coalesce(value, _reject(reason))


def _verdicts_to_columns(df: DataFrame, header: Column, footer: Column) -> DataFrame:
    """Turn ``__verdicts`` into ``sanitized`` text and ``reject_reason``."""
    bad = F.filter("__verdicts", lambda v: v.startswith("!"))
    kept = F.transform(
        F.filter("__verdicts", lambda v: v.startswith("+")), lambda v: F.substr(v, F.lit(2))
    )
    reason = F.coalesce(F.substr(F.get(bad, F.lit(0)), F.lit(2)), F.col("reject_reason"))
    body = F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("\n"))), "")
    return (
        once(
            df.withColumn("reject_reason", reason),
            sanitized=F.when(
                F.col("reject_reason").isNull(), as_bytes(F.concat(header, body, footer))
            ),
            reject_reason=F.col("reject_reason"),
        )
    )


def _identity_line(n: Column) -> Column:
    """The hashed master key of the n-th identity block."""
    key = F.get(F.col("__keys"), n)
    return _or_reject(_keep("master-key-ed25519 ", hash_base64_sha256(key)), "unreadable identity")


def _with_identity(df: DataFrame, blocks: str) -> DataFrame:
    """Cut out key blocks and read the master keys of identity blocks.

    One scan from left to right finds both kinds of block, so neither is looked
    for inside the other.
    """
    bodies = F.filter(
        F.regexp_extract_all(F.col("__text"), F.lit(blocks), F.lit(2)), lambda b: b != ""
    )
    certs = F.transform(
        bodies, lambda b: F.regexp_replace(b, r"(?dm)^-----BEGIN ED25519 CERT-----$|\n", "")
    )
    clean = F.regexp_replace(F.regexp_replace(F.col("__text"), blocks, "$1"), _AFTER_SIGNATURE, "")
    stated = F.regexp_extract_all("__clean", F.lit(r"(?dm)^master-key-ed25519 (.*)$"), F.lit(1))
    return (
        df.withColumn("__keys", F.transform(certs, master_key_from_cert))
        .withColumn("__clean", clean)
        .withColumn(
            "__mismatch",
            F.size(F.array_distinct(F.concat(stated, F.filter("__keys", lambda k: k.isNotNull()))))
            > 1,
        )
        .withColumn("__lines", lines_of(F.col("__clean")))
    )


def _identities_before(i: Column) -> Column:
    return F.size(
        F.filter(F.slice("__lines", 1, i), lambda x: x == "identity-ed25519")
    )


def _digest_footer(kind: str) -> tuple[Column, Column]:
    digest = double_digest(F.col("__text"), kind)
    sha256 = F.when(F.size("__keys") > 0, double_digest_sha256(F.col("__text"), kind))
    footer = F.concat(
        F.coalesce(F.concat(F.lit("router-digest-sha256 "), sha256, F.lit("\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("router-digest "), F.col("__digest"), F.lit("\n")), F.lit("")),
    )
    return digest, footer


def _annotation(kind: str) -> Column:
    return F.lit(f"@type {ANNOTATIONS[kind]}\n")


def _result(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return df.select(
        *inputs, "published", "digest", "sanitized", "reject_reason"
    )


def sanitize_server_descriptor(
    df: DataFrame, raw: str = "raw", secret: str | None = None
) -> DataFrame:
    """Sanitized bridge server descriptors.

    Adds ``published``, ``digest``, ``sanitized`` and ``reject_reason``; a
    rejected row has no ``sanitized``.
    """
    key = F.col(secret) if secret else None
    fp, address = F.col("__fp"), F.col("__address")
    secret_missing = key.isNull() if secret else F.lit(False)

    def verdict(line: Column, i: Column) -> Column:
        f = fields_of(line)
        plain = F.regexp_replace(line, r"\Aopt ", "")
        opt = F.regexp_extract(line, r"\A(opt )?", 1)
        own_address = F.substr(line, F.lit(8), F.length(address)) == address
        after_address = F.substr(line, F.length(address) + 8)
        extra = fields_of(plain)
        b64 = F.get(extra, F.lit(2))
        members = fields_of(F.substr(line, F.lit(8)))
        return (
            F.when(
                line.startswith("router "),
                F.when(
                    F.size(f) == 6,
                    _or_reject(
                        _keep(
                            "router ",
                            f[1],
                            " ",
                            scrub_ipv4(f[2], fp, key),
                            " ",
                            scrub_tcp_port(f[3], fp, key),
                            " ",
                            scrub_tcp_port(f[4], fp, key),
                            " ",
                            scrub_tcp_port(f[5], fp, key),
                        ),
                        "bad address or port",
                    ),
                ).otherwise(_reject("bad router line")),
            )
            .when(
                line.startswith("or-address "),
                _or_reject(
                    _keep(
                        "or-address ", scrub_or_address(F.substr(line, F.lit(12)), fp, key)
                    ),
                    "bad or-address",
                ),
            )
            .when(line.startswith("published "), _keep(line))
            .when(
                plain.startswith("fingerprint "),
                _or_reject(
                    _keep(
                        opt,
                        "fingerprint ",
                        grouped_by_four(
                            hash_fingerprint(
                                F.replace(F.substr(plain, F.lit(13)), F.lit(" "), F.lit(""))
                            )
                        ),
                    ),
                    "bad fingerprint",
                ),
            )
            .when(line.startswith("contact "), _keep("contact somebody"))
            .when(
                plain.startswith("extra-info-digest "),
                F.when(F.size(extra) > 3, _reject("long extra-info-digest line"))
                .when(b64.isNotNull() & ~is_base64(b64), _reject("bad extra-info-digest"))
                .otherwise(
                    _or_reject(
                        _keep(
                            opt,
                            "extra-info-digest ",
                            hash_fingerprint(F.get(extra, F.lit(1))),
                            F.coalesce(F.concat(F.lit(" "), hash_base64_sha256(b64)), F.lit("")),
                        ),
                        "bad extra-info-digest",
                    )
                ),
            )
            .when(
                line.startswith("reject "),
                F.when(
                    (address != "") & own_address & after_address.rlike(r"\A(?:[:/ ]|\z)"),
                    _or_reject(
                        _keep("reject ", scrub_ipv4(address, fp, key), after_address), "bad address"
                    ),
                ).otherwise(_keep(line)),
            )
            .when(line == "identity-ed25519", _identity_line(_identities_before(i)))
            .when(line.startswith("master-key-ed25519 "), _drop())
            .when(line.rlike(SERVER_KEPT_LINES), _keep(line))
            .when(
                line.startswith("family "),
                F.when(
                    F.exists(
                        members, lambda m: m.startswith("$") & ~is_hex(F.substr(m, F.lit(2)))
                    ),
                    _reject("bad family member"),
                ).otherwise(
                    _keep(
                        "family ",
                        F.array_join(
                            F.transform(
                                members,
                                lambda m: F.when(
                                    m.startswith("$"),
                                    F.concat(
                                        F.lit("$"), hash_fingerprint(F.substr(m, F.lit(2)))
                                    ),
                                ).otherwise(m),
                            ),
                            " ",
                        ),
                    )
                ),
            )
            .when(
                line.startswith("@purpose ")
                | line.startswith("-----END ")
                | line.startswith("router-sig-ed25519 "),
                _drop(),
            )
            .otherwise(_reject("unrecognized line"))
        )

    digest, footer = _digest_footer("server")
    inputs = [c for c in df.columns if c != raw]
    work = _with_identity(
        df.withColumn("__text", unix_lines(as_text(F.col(raw)))),
        rf"(?dms){_IDENTITY_BLOCK}|{_CRYPTO_BLOCK}",
    )
    work = (
        work.withColumn("published", last_line_value(F.col("__clean"), "published"))
        .withColumn(
            "__fp",
            F.replace(
                last_line_value(F.col("__clean"), "(?:opt )?fingerprint"), F.lit(" "), F.lit("")
            ),
        )
        .withColumn(
            "__address", F.regexp_extract("__clean", r"(?dm)^router \S+ (\S+) \S+ \S+ \S+ *$", 1)
        )
        .withColumn("__verdicts", F.transform("__lines", verdict))
        .withColumn("__digest", digest)
        .withColumn("digest", F.lower("__digest"))
        .withColumn(
            "reject_reason",
            F.when(F.col("__mismatch"), "identity mismatch")
            .when(
                (address == "") | fp.isNull() | F.col("published").isNull(),
                "missing router, fingerprint or published",
            )
            .when(secret_missing, "no secret for this month")
            .when(F.lit(bool(secret)) & (F.length(fp) != 40), "bad fingerprint")
            .when(F.col("__digest").isNull(), "no signature"),
        )
    )
    return _result(_verdicts_to_columns(work, _annotation("bridge-server"), footer), inputs)


def sanitize_extra_info(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Sanitized bridge extra-info descriptors; columns as for server descriptors."""

    def verdict(line: Column, i: Column) -> Column:
        f = fields_of(line)
        return (
            F.when(
                line.startswith("extra-info "),
                F.when(
                    F.size(f) >= 3,
                    _or_reject(
                        _keep("extra-info ", f[1], " ", hash_fingerprint(f[2])), "bad fingerprint"
                    ),
                ).otherwise(_reject("bad extra-info line")),
            )
            .when(line.startswith("published "), _keep(line))
            .when(
                line.startswith("transport "),
                F.when(F.size(f) >= 3, _keep("transport ", f[1])).otherwise(
                    _reject("bad transport line")
                ),
            )
            .when(line.startswith("transport-info "), _drop())
            .when(line == "identity-ed25519", _identity_line(_identities_before(i)))
            .when(line.startswith("master-key-ed25519 "), _drop())
            .when(line.rlike(EXTRA_INFO_KEPT_LINES), _keep(line))
            .when(line.startswith("router-sig-ed25519 "), _drop())
            .otherwise(_reject("unrecognized line"))
        )

    digest, footer = _digest_footer("extra-info")
    inputs = [c for c in df.columns if c != raw]
    work = _with_identity(
        df.withColumn("__text", unix_lines(as_text(F.col(raw)))), rf"(?dms){_IDENTITY_BLOCK}"
    )
    work = (
        work.withColumn("published", last_line_value(F.col("__clean"), "published"))
        .withColumn("__verdicts", F.transform("__lines", verdict))
        .withColumn("__digest", digest)
        .withColumn("digest", F.lower("__digest"))
        .withColumn(
            "reject_reason",
            F.when(F.col("__mismatch"), "identity mismatch")
            .when(F.col("published").isNull(), "missing published")
            .when(F.col("__digest").isNull(), "no signature"),
        )
    )
    return _result(_verdicts_to_columns(work, _annotation("bridge-extra-info"), footer), inputs)


# --- network statuses ---------------------------------------------------------------


def sanitize_network_status(
    df: DataFrame,
    raw: str = "raw",
    authority: str = "authority",
    default_published: str = "default_published",
    secrets: str | None = None,
) -> DataFrame:
    """Sanitized bridge network statuses.

    ``authority`` is the expected authority fingerprint, ``default_published``
    the time to use without a published line.  ``secrets`` names a column of
    type map<month, secret>: an entry is hashed with the secret of its own
    month.  Entries come out sorted by hashed identity; of entries with the same
    identity the last wins.
    """

    def entry(part: Column) -> Column:
        """Key, time and verdicts of one r line and the lines that follow it."""
        f = fields_of(F.substring_index(part, "\n", 1))
        return let(f, lambda f: let(_entry_keys(f), lambda e: verdicts(part, f, e)))

    def _entry_keys(f: Column) -> Column:
        time = F.concat_ws(" ", F.get(f, F.lit(4)), F.get(f, F.lit(5)))
        key = F.try_element_at(F.col(secrets), F.substring(time, 1, 7)) if secrets else F.lit(None)
        return F.struct(
            F.upper(base64_to_hex(F.get(f, F.lit(2)))).alias("fp"),
            time.alias("time"),
            key.cast("binary").alias("secret"),
        )

    def verdicts(part: Column, f: Column, e: Column) -> Column:
        fp, time, key = e["fp"], e["time"], e["secret"] if secrets else None
        r_line = F.concat_ws(
            " ",
            F.lit("r"),
            F.get(f, F.lit(1)),
            hash_base64_sha1(F.get(f, F.lit(2))),
            hash_base64_sha1(F.get(f, F.lit(3))),
            time,
        )
        rest = F.concat(
            F.lit(" "),
            scrub_ipv4(F.get(f, F.lit(6)), fp, key),
            F.lit(" "),
            scrub_tcp_port(F.get(f, F.lit(7)), fp, key),
            F.lit(" "),
            scrub_tcp_port(F.get(f, F.lit(8)), fp, key),
        )
        r_verdict = (
            F.when(F.size(f) < 9, _reject("short r line"))
            .when(~is_base64(F.get(f, F.lit(2))), _reject("bad identity"))
            .when(F.length(fp) != 40, _reject("bad identity"))
            .otherwise(_or_reject(_keep(r_line, rest), "bad address or port"))
        )

        def other(line: Column) -> Column:
            return (
                F.when(
                    line.startswith("a "),
                    F.coalesce(
                        _keep("a ", scrub_or_address(F.substr(line, F.lit(3)), fp, key)),
                        _drop(),
                    ),
                )
                .when(line.rlike(r"\A[swp](?: |\z)"), _keep(line))
                .when(line.rlike(r"\A(?:published|flag-thresholds|fingerprint) "), _drop())
                .otherwise(_reject("unrecognized line"))
            )

        following = let(
            lines_of(part), lambda x: F.transform(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), other)
        )
        return F.struct(
            F.lower(F.sha1(F.unhex(fp))).alias("key"),
            time.alias("time"),
            F.concat(F.array(r_verdict), following).alias("verdicts"),
        )

    inputs = [c for c in df.columns if c != raw]
    text = F.col("__text")
    header_lines = F.filter(lines_of(F.col("__parts")[0]), lambda x: x != "")
    bad_header = F.exists(
        header_lines, lambda x: ~x.rlike(r"\A(?:published|flag-thresholds|fingerprint) ")
    )
    header = F.regexp_extract_all(
        text, F.lit(r"(?dm)^((?:flag-thresholds|fingerprint) .*)$"), F.lit(1)
    )
    stated = F.filter("__header", lambda x: x.startswith("fingerprint "))
    expected = F.concat(F.lit("fingerprint "), F.col(authority))
    keyed = F.transform(
        "__entries",
        lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["verdicts"].alias("v")),
    )
    newest = F.array_max(
        F.filter(
            F.zip_with(
                F.transform("__entries", lambda e: e["time"]),
                F.array_repeat("published", F.size("__entries")),
                lambda t, p: F.when(t <= p, t),
            ),
            lambda t: t.isNotNull(),
        )
    )
    work = (
        df.withColumn("__text", unix_lines(as_text(F.col(raw))))
        .withColumn("__parts", sections(text, "r "))
        .withColumn("published", F.coalesce(last_line_value(text, "published"), default_published))
        .withColumn("__header", header)
        .withColumn(
            "__entries",
            F.transform(F.slice("__parts", 2, F.size("__parts")), entry),
        )
        .withColumn("__sorted", last_per_key(keyed, "key"))
        .withColumn("newest_entry", newest)
        .withColumn("n_entries", F.size("__entries"))
        .withColumn(
            "__verdicts",
            F.flatten(F.transform("__entries", lambda e: e["verdicts"])),
        )
    )
    first_bad = F.get(F.filter("__verdicts", lambda v: v.startswith("!")), F.lit(0))
    kept_entries = F.flatten(F.transform("__sorted", lambda e: e["v"]))
    body = F.array_join(
        F.transform(
            F.filter(kept_entries, lambda v: v.startswith("+")),
            lambda v: F.concat(F.substr(v, F.lit(2)), F.lit("\n")),
        ),
        "",
    )
    header_text = F.concat(
        F.array_join(F.transform("__header", lambda x: F.concat(x, F.lit("\n"))), ""),
        F.when(F.size(stated) == 0, F.concat(expected, F.lit("\n"))).otherwise(""),
    )
    decided = (
        work.withColumn(
            "reject_reason",
            F.when(bad_header, "unrecognized line")
            .when(
                F.size(F.array_except(stated, F.array(expected))) > 0, "authority mismatch"
            )
            .otherwise(F.substr(first_bad, F.lit(2))),
        )
        .withColumn(
            "sanitized",
            F.when(
                F.col("reject_reason").isNull(),
                as_bytes(
                    F.concat(
                        _annotation("bridge-status"),
                        F.lit("published "),
                        F.col("published"),
                        F.lit("\n"),
                        header_text,
                        body,
                    )
                ),
            ),
        )
    )
    outputs = ("published", "n_entries", "newest_entry", "sanitized", "reject_reason")
    return once(decided, **{c: F.col(c) for c in outputs}).select(*inputs, *outputs)


def status_freshness(
    df: DataFrame,
    keys: Sequence[str],
    status_time: str,
    entry_time: str,
) -> DataFrame:
    """Newest entry not after its status; stale when none or over an hour older."""
    newest = F.max(F.when(F.col(entry_time) <= F.col(status_time), F.col(entry_time)))
    return (
        df.groupBy(*keys, status_time)
        .agg(newest.alias("newest_entry"), F.count(F.lit(1)).alias("n_entries"))
        .withColumn(
            "stale",
            F.col("newest_entry").isNull() | (F.col("newest_entry") < F.col(status_time) - span(STALE_ENTRIES_AFTER)),
        )
    )


# --- pool assignments ------------------------------------------------------------------


def sanitize_pool_assignments(
    df: DataFrame, published: str = "published", fingerprint: str = "fingerprint"
) -> DataFrame:
    """Hash fingerprints; one that is no hex rejects all lines of its file and time.

    Rows without a ``path`` are taken as one file.
    """
    group = [c for c in ("path", published) if c in df.columns]
    good = without_groups(df, group, ~is_hex(F.col(fingerprint)))
    return good.withColumn("hashed_fingerprint", F.lower(hash_fingerprint(F.col(fingerprint)))).drop(
        fingerprint
    )

