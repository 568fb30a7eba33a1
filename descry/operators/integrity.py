"""References between documents, completeness of statuses, and the work list."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.formats import (
    COMPLETE_PER_MILLE,
    EXEMPT_VOTE,
    KEEP_MISSING_KEYS,
    MISSING_WEIGHT_LIMIT,
    REPORTED_STATUS_AGE,
)
from descry.functions.times import at, span
from descry.operators.keys import keep_first
from descry.operators.ordering import running_total
from descry.session import checkpointed

# --- fixed values: weight and lifetime of reference edges -------------------------
STATUS_WEIGHT = 1.0
ENTRIES_WEIGHT = 200.0
SERVER_WEIGHT = 0.01
EXTRA_INFO_WEIGHT = 0.005
MICRODESC_WEIGHT = 0.0
THREE_HOURS = timedelta(hours=3)
SIX_HOURS = timedelta(hours=6)
THIRTY_DAYS = timedelta(days=30)


def _plus(time: Column | str, delta: timedelta) -> Column:
    return (F.col(time) if isinstance(time, str) else time) + span(delta)


def _status_name(prefix: str, time: str, *more: str) -> Column:
    return F.upper(
        F.concat_ws("-", F.lit(prefix), F.date_format(time, "yyyy-MM-dd-HH-mm-ss"), *more)
    )


def entry_weights(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """200 over the number of entries, per status.

    Entries that carry the number themselves need no shuffle.  Others are counted by a
    combinable aggregate and joined back on the status, so a status with a third of all
    entries is not gathered.
    """
    if "n_entries" in entries.columns:
        return entries.withColumn("weight", ENTRIES_WEIGHT / F.col("n_entries"))
    sizes = entries.groupBy(*keys).agg((ENTRIES_WEIGHT / F.count(F.lit(1))).alias("weight"))
    return entries.join(sizes, list(keys))


def reference_edges(
    statuses: DataFrame,
    dir_sources: DataFrame,
    entries: DataFrame,
    servers: DataFrame,
    extra_infos: DataFrame,
    microdescs: DataFrame,
    now: datetime,
    to: str | None = None,
) -> DataFrame:
    """Edges (referencing, referenced, weight, expires_at) between documents.

    ``statuses`` has kind, valid_after, fingerprint; ``dir_sources`` the
    authorities with a vote digest; ``entries`` one row per entry.  Digests are
    hex throughout, so upper-casing them loses nothing.  Statuses and entries of
    all kinds are each read in one pass, as parsing them is what costs.

    ``to`` asks only for edges to documents of one letter.  They are the same as
    among all edges, since equal edges have one target; inputs that lead to
    documents of other letters are not read.
    """
    edge = ("referencing", "referenced", "weight", "expires_at")

    def edges(df: DataFrame, a: Column, b: Column, weight: Column, expires: Column) -> DataFrame:
        return df.select(
            a.alias(edge[0]), F.upper(b).alias(edge[1]), weight.alias(edge[2]), expires.alias(edge[3])
        )

    one = F.lit(STATUS_WEIGHT)
    until = _plus("valid_after", THREE_HOURS)
    kind = F.col("kind")
    of_consensus, of_micro = kind == "consensus", kind == "consensus-microdesc"
    c, m = _status_name("C", "valid_after"), _status_name("M", "valid_after")
    v = _status_name("V", "valid_after", "fingerprint")

    def leading_to(letters: dict[str, str]) -> Column:
        """Whether the letter that a status's kind leads to is asked for."""
        return kind.isin(*[k for k, letter in letters.items() if to in (None, letter)])

    entries = entries.withColumn("fingerprint", F.coalesce("fingerprint", F.lit(""))).filter(
        leading_to({"consensus": "S", "consensus-microdesc": "D", "vote": "S"})
    )
    weighted = entry_weights(entries, ["kind", "valid_after", "fingerprint"])
    server = F.lit(True) if to is None else F.col("server_digest").isNotNull()
    extra_info = F.concat(F.lit("E-"), F.col("extra_info_digest"))
    nothing = F.lit("")
    parts = {
        "CM": edges(
            statuses.filter(leading_to({"consensus": "M", "consensus-microdesc": "C"})),
            F.when(of_consensus, c).otherwise(m),
            F.when(of_consensus, m).otherwise(c),
            one,
            until,
        ),
        "V": edges(
            dir_sources.filter(of_consensus),
            c,
            _status_name("V", "valid_after", "identity"),
            one,
            until,
        ),
        "SD": edges(
            weighted.filter(F.when(of_micro, F.col("micro_digest").isNotNull()).otherwise(server)),
            F.when(of_consensus, c).when(of_micro, m).otherwise(v),
            F.when(of_micro, F.concat(F.lit("D-"), F.col("micro_digest"))).otherwise(
                F.concat(F.lit("S-"), F.col("server_digest"))
            ),
            F.col("weight"),
            F.col("published")
            + F.when(kind == "vote", span(SIX_HOURS)).otherwise(span(THREE_HOURS)),
        ),
        "E": edges(
            servers if to is None else servers.filter(F.col("extra_info_digest").isNotNull()),
            F.upper(F.concat(F.lit("S-"), F.col("digest"))),
            F.coalesce(extra_info, nothing),
            F.lit(SERVER_WEIGHT),
            _plus("published", SIX_HOURS),
        ),
    }
    ends = [
        edges(
            extra_infos,
            F.upper(F.concat(F.lit("E-"), F.col("digest"))),
            nothing,
            F.lit(EXTRA_INFO_WEIGHT),
            _plus("published", SIX_HOURS),
        ),
        edges(
            microdescs,
            F.upper(F.concat(F.lit("D-"), F.col("sha256_hex"))),
            nothing,
            F.lit(MICRODESC_WEIGHT),
            _plus(at(now), THIRTY_DAYS),
        ),
    ]
    chosen = [*parts.values(), *ends]
    if to is not None:
        chosen = [part for letters, part in parts.items() if to in letters]
    union = chosen[0]
    for part in chosen[1:]:
        union = union.unionByName(part)
    return keep_first(union, ["referencing", "referenced"], ["expires_at", "weight"])


def missing_references(edges: DataFrame) -> DataFrame:
    """Edges to documents that no edge starts from."""
    known = edges.select(F.col("referencing").alias("referenced")).distinct()
    return edges.filter(F.col("referenced") != "").join(known, "referenced", "left_anti")


def first_referencers(missing: DataFrame) -> DataFrame:
    """Per missing document the first edge, the only one whose weight counts."""
    return missing.groupBy("referenced").agg(
        F.min("referencing").alias("referencing"), F.min_by("weight", "referencing").alias("counted")
    )


def with_running_weight(missing: DataFrame) -> DataFrame:
    """Missing edges in order, with the running total of counted weights.

    The missing edges are written out once: finding them takes joins, and they
    are read three times.  The join below is on the whole edge, which is unique,
    so a document that everything refers to causes no skew.
    """
    missing = checkpointed(missing)
    first = first_referencers(missing)
    marked = missing.join(first, ["referencing", "referenced"], "left")
    return running_total(
        marked,
        ["referencing", "referenced"],
        F.coalesce("counted", F.lit(0.0)),
        "running_weight",
    ).drop("counted")


def missing_weight(missing: DataFrame, threshold: float = MISSING_WEIGHT_LIMIT) -> DataFrame:
    """Total weight of missing documents, each counted once, and an alert flag."""
    total = F.coalesce(F.sum("counted"), F.lit(0.0))
    return first_referencers(missing).agg(
        F.count(F.lit(1)).alias("n_missing"),
        total.alias("missing_weight"),
        (total > threshold).alias("alert"),
    )


# --- completeness -------------------------------------------------------------------


def completeness(
    entries: DataFrame,
    servers: DataFrame,
    extra_infos: DataFrame,
    microdescs: DataFrame,
    keys: Sequence[str] = ("kind", "valid_after", "fingerprint"),
) -> DataFrame:
    """Found and referenced descriptors per status.

    Digests count once per status.  The known sets carry one row per digest and
    no documents.
    """
    keys = list(keys)
    one, zero = F.lit(1), F.lit(0)
    known_e = extra_infos.select(F.col("digest").alias("__key"), one.alias("__e")).distinct()
    # without an extra-info digest a server gets a key of its own that matches
    # nothing: nulls would all meet in one task
    key = F.coalesce("__extra", F.concat(F.lit("\x00"), "digest"))
    known_s = (
        servers.groupBy("digest")
        .agg(F.max("extra_info_digest").alias("__extra"))
        .withColumn("__key", key)
        .join(known_e, "__key", "left")
        .select(
            "digest",
            one.alias("__s"),
            F.col("__extra").isNotNull().cast("int").alias("__has_e"),
            F.coalesce("__e", zero).alias("__e"),
        )
    )
    known_m = microdescs.select(F.col("sha256_hex").alias("micro_digest"), one.alias("__m"))
    by_server = (
        entries.filter(F.col("server_digest").isNotNull())
        .select(*keys, F.col("server_digest").alias("digest"))
        .distinct()
        .join(known_s, "digest", "left")
        .select(
            *keys,
            one.alias("all_s"),
            F.coalesce("__s", zero).alias("found_s"),
            F.coalesce("__has_e", zero).alias("all_e"),
            F.coalesce("__e", zero).alias("found_e"),
            zero.alias("all_m"),
            zero.alias("found_m"),
        )
    )
    by_micro = (
        entries.filter(F.col("micro_digest").isNotNull())
        .select(*keys, "micro_digest")
        .distinct()
        .join(known_m.distinct(), "micro_digest", "left")
        .select(
            *keys,
            *[zero.alias(c) for c in ("all_s", "found_s", "all_e", "found_e")],
            one.alias("all_m"),
            F.coalesce("__m", zero).alias("found_m"),
        )
    )
    sums = ("all_s", "found_s", "all_e", "found_e", "all_m", "found_m")
    return by_server.unionByName(by_micro).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def percent(found: Column, everything: Column) -> Column:
    return F.when(everything > 0, F.round(found * 100.0 / everything, 1))


def below(found: str, everything: str) -> Column:
    return F.col(found) * 1000 < F.col(everything) * COMPLETE_PER_MILLE


def completeness_report(
    counts: DataFrame,
    votes: DataFrame,
    expected: DataFrame,
    statuses: DataFrame,
    now: datetime,
) -> DataFrame:
    """Percentages and flags for statuses newly stored and under three hours old.

    ``votes`` has one row per stored vote (valid_after, fingerprint), ``expected``
    the votes each consensus lists, ``statuses`` what was newly stored.
    """
    reported = statuses.filter(
        F.col("valid_after") > at(now - REPORTED_STATUS_AGE)
    ).select("kind", "valid_after", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    micro = statuses.filter(F.col("kind") == "consensus-microdesc").select(
        "valid_after", F.lit(True).alias("__has_micro")
    ).distinct()
    n_votes = votes.select("valid_after", "fingerprint").distinct().groupBy("valid_after").agg(
        F.count(F.lit(1)).alias("found_v")
    )
    is_consensus = F.col("kind") == "consensus"
    exempt = (F.col("kind") == "vote") & (F.upper("fingerprint") == EXEMPT_VOTE)
    sums = ("all_s", "found_s", "all_e", "found_e", "all_m", "found_m")
    joined = (
        reported.join(counts, ["kind", "valid_after", "fingerprint"], "left")
        .join(n_votes, "valid_after", "left")
        .join(expected, "valid_after", "left")
        .join(micro, "valid_after", "left")
        .fillna(0, [*sums, "found_v", "expected_votes"])
    )
    return joined.select(
        "kind",
        "valid_after",
        "fingerprint",
        *sums,
        percent(F.col("found_s"), F.col("all_s")).alias("percent_s"),
        percent(F.col("found_e"), F.col("all_e")).alias("percent_e"),
        percent(F.col("found_m"), F.col("all_m")).alias("percent_m"),
        F.when(is_consensus, F.col("found_v")).alias("found_v"),
        F.when(is_consensus, F.col("expected_votes")).alias("all_v"),
        (
            ~exempt
            & (below("found_s", "all_s") | below("found_e", "all_e") | below("found_m", "all_m"))
        ).alias("missing_descriptors"),
        (is_consensus & (F.col("found_v") < F.col("expected_votes"))).alias("missing_votes"),
        (is_consensus & F.col("__has_micro").isNull()).alias("missing_microdesc_consensus"),
    )


# --- work list of missing keys -------------------------------------------------------

WORK_KEY = ("type", "time", "relay_id", "digest")
# --- fixed values: types kept for 30 hours, and types kept for the current hour ------
WINDOWED_TYPES = ("server", "extra", "micro")
HOURLY_TYPES = ("consensus", "consensus-microdesc", "vote")


def in_work_window(now: datetime) -> Column:
    """Keys still worth looking for."""
    cutoff = at(now - KEEP_MISSING_KEYS)
    hour = at(now.replace(minute=0, second=0, microsecond=0))
    return (F.col("type").isin(*WINDOWED_TYPES) & (F.col("time") > cutoff)) | (
        F.col("type").isin(*HOURLY_TYPES) & (F.col("time") == hour)
    )


def update_missing(
    state: DataFrame,
    referenced: DataFrame,
    seen: DataFrame,
    now: datetime,
    seen_micro: DataFrame | None = None,
) -> DataFrame:
    """The next work list (type, time, relay_id, digest, parsed_at).

    Referenced keys enter as missing, seen keys get ``now``, overwriting an
    earlier time.  The full outer join of the three sides is one union and one
    combinable aggregate.  A referenced microdescriptor already parsed under
    another key of the same month counts as parsed; ``seen_micro`` (digest)
    marks every key of that digest.
    """
    seen_at = at(now)
    none = F.lit(None).cast("timestamp")

    def side(df: DataFrame, old: Column, new: Column, referenced_now: int) -> DataFrame:
        return df.select(
            *WORK_KEY, old.alias("__old"), new.alias("__new"), F.lit(referenced_now).alias("__ref")
        )

    merged = (
        side(state, F.col("parsed_at"), none, 0)
        .unionByName(side(referenced, none, none, 1))
        .unionByName(side(seen, none, seen_at, 0))
        .filter(in_work_window(now))
        .groupBy(*WORK_KEY)
        .agg(
            F.max("__new").alias("__new"), F.max("__old").alias("__old"), F.max("__ref").alias("__ref")
        )
        .withColumn("parsed_at", F.coalesce("__new", "__old"))
    )
    is_micro = F.col("type") == "micro"
    month = F.date_format("time", "yyyy-MM").alias("__month")
    parsed_this_month = (
        state.filter(in_work_window(now) & is_micro & F.col("parsed_at").isNotNull())
        .groupBy("digest", month)
        .agg(F.max("parsed_at").alias("__same_month"))
    )
    others = merged.filter(~is_micro).select(*WORK_KEY, "parsed_at")
    micro = (
        merged.filter(is_micro)
        .withColumn("__month", F.date_format("time", "yyyy-MM"))
        .join(parsed_this_month, ["digest", "__month"], "left")
        .withColumn(
            "parsed_at",
            F.coalesce("parsed_at", F.when(F.col("__ref") == 1, F.col("__same_month"))),
        )
    )
    if seen_micro is not None:
        marks = seen_micro.select("digest", seen_at.alias("__mark")).distinct()
        micro = micro.join(marks, "digest", "left").withColumn(
            "parsed_at", F.coalesce("__mark", "parsed_at")
        )
    return others.unionByName(micro.select(*WORK_KEY, "parsed_at"))


def missing_counts(worklist: DataFrame) -> DataFrame:
    """Still missing per type; microdescriptors by distinct digest.

    Distinct first, then count, so both steps combine before their shuffle.
    """
    what = F.when(F.col("type") == "micro", F.struct(F.lit("").alias("a"), F.col("digest").alias("b")))
    key = F.coalesce(
        what, F.struct(F.concat_ws(",", "time", "relay_id").alias("a"), F.col("digest").alias("b"))
    )
    return (
        worklist.filter(F.col("parsed_at").isNull())
        .select("type", key.alias("__key"))
        .distinct()
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("n_missing"))
    )
