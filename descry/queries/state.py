"""State over several runs: reference edges, known digests, wanted keys, requests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.operators.integrity import missing_references
from descry.plans.derived import EVENTS_NOW, as_time_text, table, text_of
from descry.plans.relay_state import RelayState, request_batches
from descry.queries.registry import registered
from descry.sinks.buckets import BucketedState
from descry.session import scratch_path

# --- fixed values: when the runs take place, and which events each gets ---------------
RUNS = (datetime(2024, 1, 10), datetime(2024, 1, 20), EVENTS_NOW)
WORK_RUNS = (EVENTS_NOW - timedelta(hours=4), EVENTS_NOW - timedelta(hours=2), EVENTS_NOW)


def _batch(number: int) -> Column:
    """Events up to a run, since the run before; a fifth of all earlier ones come again."""
    ts = F.col("ts").cast("timestamp")
    arrived = ts <= F.lit(RUNS[number]).cast("timestamp")
    if number:
        arrived &= (ts > F.lit(RUNS[number - 1]).cast("timestamp")) | (F.col("event_id") % 5 == 0)
    return arrived


def _edge_state(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that three runs over the events leave behind."""
    state = RelayState(scratch_path(spark, "edge-state"))
    days = F.make_dt_interval(days=(F.col("event_id") % 12 + 1).cast("int"))
    known = (F.col("event_type") == "click") & (F.col("event_id") % 3 == 0)
    user = text_of("U-", F.col("user_id"))
    events = table(spark, folder, "events")
    edges = None
    for number, now in enumerate(RUNS):
        batch = events.filter(_batch(number)).select(
            F.when(known, text_of("E-", F.col("event_id") % 50)).otherwise(user).alias("referencing"),
            F.when(known, "").otherwise(text_of("E-", F.col("event_id") % 50)).alias("referenced"),
            F.col("value").alias("weight"),
            (F.col("ts").cast("timestamp") + days).alias("expires_at"),
        )
        edges = state.remember_edges(batch, now)
    return edges


_R = [f"TIMESTAMP '{r}'" for r in RUNS]
_EDGES_SQL = f"""
WITH e AS (
  SELECT CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'E-' || (event_id % 50)
              ELSE 'U-' || user_id END AS a,
         CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN '' ELSE 'E-' || (event_id % 50) END AS b,
         value AS w, ts + INTERVAL 1 DAY * (event_id % 12 + 1) AS x, ts, event_id FROM events),
s1 AS (
  SELECT a, b, w, x FROM e WHERE ts <= {_R[0]} AND x >= {_R[0]}
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY w, x) = 1),
s2 AS (
  SELECT * FROM s1 WHERE x >= {_R[1]} UNION ALL
  SELECT a, b, w, x FROM e
  WHERE ts <= {_R[1]} AND (ts > {_R[0]} OR event_id % 5 = 0) AND x >= {_R[1]}
    AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.a = e.a AND s1.b = e.b AND s1.x >= {_R[1]})
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY w, x) = 1),
s3 AS (
  SELECT * FROM s2 WHERE x >= {_R[2]} UNION ALL
  SELECT a, b, w, x FROM e
  WHERE ts <= {_R[2]} AND (ts > {_R[1]} OR event_id % 5 = 0) AND x >= {_R[2]}
    AND NOT EXISTS (SELECT 1 FROM s2 WHERE s2.a = e.a AND s2.b = e.b AND s2.x >= {_R[2]})
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY w, x) = 1)
"""


@registered(
    _EDGES_SQL
    + """SELECT a AS referencing, b AS referenced, round(w, 6) AS weight,
           strftime(x, '%Y-%m-%d %H:%M:%S') AS expires_at FROM s3"""
)
def edge_state_after_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Edges after three runs: what is stored wins until it expires."""
    return _edge_state(spark, folder).select(
        "referencing", "referenced", F.round("weight", 6).alias("weight"),
        as_time_text("expires_at").alias("expires_at"),
    )


@registered(
    _EDGES_SQL
    + """SELECT a AS referencing, b AS referenced FROM s3 m WHERE b <> ''
           AND NOT EXISTS (SELECT 1 FROM s3 k WHERE k.a = m.b)"""
)
def missing_after_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Edges to documents that no run has brought, or that are forgotten."""
    return missing_references(_edge_state(spark, folder)).select("referencing", "referenced")


# --- digests by day -----------------------------------------------------------------------


@registered(f"""
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen, min(value) AS value
FROM events WHERE ts >= {_R[2]} - INTERVAL 2 DAY AND ts <= {_R[2]} GROUP BY ALL
""")
def known_digests_after_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Two days of keys, from three runs of which the later ones get earlier rows again."""
    state = BucketedState(
        scratch_path(spark, "digests"), "user_id long, event_type string, ts timestamp, value double",
        ("user_id", "event_type", "ts"), "ts", timed=True,
    )
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    keep = timedelta(days=2)
    least = events.groupBy("user_id", "event_type", "ts").agg(F.min("value").alias("value"))
    for now in RUNS:
        state.expire(spark, now - keep)
        state.insert(least.filter(F.col("ts") <= F.lit(now).cast("timestamp")), now - keep)
    return state.read(spark, RUNS[-1] - keep).select(
        "user_id", "event_type", as_time_text("ts").alias("seen"), "value"
    )


# --- wanted keys -------------------------------------------------------------------------------


def _work_after_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of a third of the events enter in each run; half of them land in the next one."""
    state = RelayState(scratch_path(spark, "work-state"))
    kind = F.element_at(F.array(F.lit("server"), F.lit("extra"), F.lit("micro")), (F.col("user_id") % 3 + 1).cast("int"))
    keys = table(spark, folder, "events").select(
        kind.alias("type"),
        F.col("ts").cast("timestamp").alias("time"),
        text_of("r", F.col("user_id")).alias("relay_id"),
        text_of("d", F.col("event_id")).alias("digest"),
        (F.col("event_id") % 3).alias("run"),
        "value",
    )
    work = None
    for number, now in enumerate(WORK_RUNS):
        landed = keys.filter((F.col("run") == number - 1) & (F.col("value") > 50))
        work = state.update_work(keys.filter(F.col("run") == number), landed, now)
    return work


_N = [f"TIMESTAMP '{r}'" for r in WORK_RUNS]
_WORK_SQL = f"""
WITH work AS (
  SELECT CASE user_id % 3 WHEN 0 THEN 'server' WHEN 1 THEN 'extra' ELSE 'micro' END AS type,
         ts AS time, 'r' || user_id AS relay_id, 'd' || event_id AS digest,
         CASE WHEN value > 50 THEN CASE event_id % 3 WHEN 0 THEN {_N[1]} WHEN 1 THEN {_N[2]} END END AS parsed_at
  FROM events WHERE ts > {_N[2]} - INTERVAL 30 HOUR)
"""


@registered(
    _WORK_SQL
    + """SELECT type, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, relay_id, digest,
           coalesce(strftime(parsed_at, '%Y-%m-%d %H:%M:%S'), 'NA') AS parsed_at FROM work"""
)
def worklist_after_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The list of wanted keys after three runs: what landed has a time, what is old is gone."""
    return _work_after_runs(spark, folder).select(
        "type", as_time_text("time").alias("time"), "relay_id", "digest",
        F.coalesce(as_time_text("parsed_at"), F.lit("NA")).alias("parsed_at"),
    )


@registered(
    _WORK_SQL
    + """, numbered AS (
  SELECT type, digest, CASE type WHEN 'micro' THEN 92 ELSE 96 END AS size,
         row_number() OVER (PARTITION BY type ORDER BY digest) - 1 AS i
  FROM (SELECT DISTINCT type, digest FROM work WHERE parsed_at IS NULL))
SELECT type, i // size AS batch, count(*) AS n_keys,
       CASE type WHEN 'micro' THEN string_agg(digest, '-' ORDER BY digest)
                 ELSE string_agg(digest, '+' ORDER BY digest) END AS keys
FROM numbered GROUP BY type, i // size"""
)
def requests_after_runs(spark: SparkSession, folder: str) -> DataFrame:
    """What the third run asks for: keys not landed yet, packed."""
    return request_batches(_work_after_runs(spark, folder))
