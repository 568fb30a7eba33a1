"""What the relay job remembers: files read, documents stored, reference edges, wanted keys.

Digests and edges lie in a folder for each day of their time; a run appends to the days its
input falls in and removes days that are over.  The list of wanted keys spans thirty hours
and is saved whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.functions.times import at
from descry.operators.freshness import unexpired
from descry.operators.integrity import missing_counts, update_missing
from descry.operators.ordering import batch_keys
from descry.session import checkpointed
from descry.sinks.buckets import HORIZON, BucketedState
from descry.sinks.tables import save_state
from descry.sources.files import FILE_SCHEMA
from descry.sources.state import EDGE_SCHEMA, read_state

# --- fixed values: how long digests are remembered, and how keys are asked for ----------
KEEP_DIGESTS = timedelta(hours=48)
KEEP_MICRODESCS = timedelta(days=40)
KEYS_PER_REQUEST, SEPARATOR = 96, "+"
MICRODESCS_PER_REQUEST, MICRODESC_SEPARATOR = 92, "-"

BEGINNING = datetime(1970, 1, 1)
WORK_SCHEMA = "type string, time timestamp, relay_id string, digest string, parsed_at timestamp"
REQUESTED = ("server", "extra", "micro")


@dataclass(frozen=True)
class RelayState:
    """The state tables below one folder."""

    path: str

    @property
    def files(self) -> BucketedState:
        return BucketedState(
            f"{self.path}/files", FILE_SCHEMA, ("path", "modificationTime"), "modificationTime", True
        )

    @property
    def servers(self) -> BucketedState:
        schema = "digest string, extra_info_digest string, published timestamp"
        return BucketedState(f"{self.path}/servers", schema, ("digest", "published"), "published", True)

    @property
    def extra_infos(self) -> BucketedState:
        schema = "digest string, published timestamp"
        return BucketedState(f"{self.path}/extra-infos", schema, ("digest", "published"), "published", True)

    @property
    def microdescs(self) -> BucketedState:
        schema = "digest string, valid_after timestamp"
        return BucketedState(f"{self.path}/micro", schema, ("digest", "valid_after"), "valid_after", True)

    @property
    def edges(self) -> BucketedState:
        return BucketedState(f"{self.path}/edges", EDGE_SCHEMA, ("referencing", "referenced"), "expires_at")

    def remember_documents(
        self, servers: DataFrame, extra_infos: DataFrame, microdescs: DataFrame, now: datetime
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Add a run's digests; returns all that are known, of this run and those before.

        ``microdescs`` has the time of a status that refers to each.
        """
        spark = servers.sparkSession
        since, since_micro = now - KEEP_DIGESTS, now - KEEP_MICRODESCS
        for table, rows, start in (
            (self.servers, servers, since),
            (self.extra_infos, extra_infos, since),
            (self.microdescs, microdescs, since_micro),
        ):
            table.expire(spark, start)
            table.insert(rows, start, now + HORIZON)
        known = self.microdescs.read(spark, since_micro).select(F.col("digest").alias("sha256_hex"))
        return self.servers.read(spark, since), self.extra_infos.read(spark, since), known.distinct()

    def remember_edges(self, edges: DataFrame, now: datetime) -> DataFrame:
        """Add a run's reference edges; returns all that have not expired.

        An edge that is stored and has not expired keeps its weight and expiry.
        """
        spark = edges.sparkSession
        self.edges.expire(spark, now)
        self.edges.insert(unexpired(edges, now), now, now + HORIZON)
        return self.edges.read(spark, now)

    def update_work(
        self, referenced: DataFrame, seen: DataFrame, now: datetime, seen_micro: DataFrame | None = None
    ) -> DataFrame:
        """The list of wanted keys after a run, saved for the next one."""
        spark = referenced.sparkSession
        old = read_state(spark, f"{self.path}/work", WORK_SCHEMA)
        work = checkpointed(update_missing(old, referenced, seen, now, seen_micro))
        save_state(work, f"{self.path}/work", now)
        return work

    def compact(self, spark: SparkSession) -> None:
        for table in (self.files, self.servers, self.extra_infos, self.microdescs, self.edges):
            table.compact(spark)


def request_batches(work: DataFrame) -> DataFrame:
    """(type, batch, n_keys, keys): what to ask for next, packed and sorted."""
    micro = lambda kind: kind == "micro"
    missing = work.filter(F.col("parsed_at").isNull() & F.col("type").isin(*REQUESTED))
    return batch_keys(
        missing,
        "type",
        "digest",
        lambda kind: F.when(micro(kind), MICRODESCS_PER_REQUEST).otherwise(KEYS_PER_REQUEST),
        lambda kind: F.when(micro(kind), MICRODESC_SEPARATOR).otherwise(SEPARATOR),
    )


def referenced_keys(
    entries: DataFrame, dir_sources: DataFrame, servers: DataFrame, now: datetime
) -> DataFrame:
    """Keys that a run's documents refer to, and the statuses of the current hour."""

    def keys(df: DataFrame, kind: str, time: str, relay: str, digest: str | None) -> DataFrame:
        return df.select(
            F.lit(kind).alias("type"),
            F.col(time).alias("time"),
            F.lower(relay).alias("relay_id"),
            (F.lower(digest) if digest else F.lit("")).alias("digest"),
        )

    consensus = entries.filter("kind = 'consensus' AND server_digest IS NOT NULL")
    micro = entries.filter("kind = 'consensus-microdesc' AND micro_digest IS NOT NULL")
    hour = at(now.replace(minute=0, second=0, microsecond=0)).alias("time")
    frame = entries.sparkSession.range(1)
    statuses = [
        frame.select(F.lit(k).alias("type"), hour, F.lit("").alias("relay_id"), F.lit("").alias("digest"))
        for k in ("consensus", "consensus-microdesc")
    ]
    found = keys(consensus, "server", "published", "relay_identity", "server_digest")
    for part in (
        keys(micro, "micro", "valid_after", "relay_identity", "micro_digest"),
        keys(
            servers.filter("extra_info_digest IS NOT NULL"),
            "extra", "published", "fingerprint", "extra_info_digest",
        ),
        keys(dir_sources.filter("kind = 'consensus'"), "vote", "valid_after", "identity", None),
        *statuses,
    ):
        found = found.unionByName(part)
    return found.distinct()


def seen_keys(statuses: DataFrame, servers: DataFrame, extra_infos: DataFrame) -> DataFrame:
    """Keys of a run's documents, spelled as references spell them."""
    empty = F.lit("")

    def keys(df: DataFrame, kind, time: str, relay, digest) -> DataFrame:
        return df.select(
            kind.alias("type"), F.col(time).alias("time"), relay.alias("relay_id"), digest.alias("digest")
        )

    own = (F.lower("fingerprint"), F.lower("digest"))
    relay = F.when(F.col("kind") == "vote", F.lower("dir_source")).otherwise(empty)
    return (
        keys(statuses, F.col("kind"), "valid_after", F.coalesce(relay, empty), empty)
        .unionByName(keys(servers, F.lit("server"), "published", *own))
        .unionByName(keys(extra_infos, F.lit("extra"), "published", *own))
        .distinct()
    )


def still_missing(work: DataFrame) -> DataFrame:
    """How many keys of each type are still wanted."""
    return missing_counts(work)
