"""References, completeness, the work list and staleness."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.operators.freshness import (
    latest_and_stale,
    max_scan_time,
    retention,
    throttle_full_refresh,
    unexpired,
)
from descry.operators.integrity import (
    completeness,
    completeness_report,
    entry_weights,
    missing_counts,
    missing_references,
    missing_weight,
    percent,
    reference_edges,
    update_missing,
    with_running_weight,
)
from descry.operators.documents import parse_status, status_dir_sources, status_entries
from descry.plans.derived import (
    EVENTS_NOW,
    ORDERS_NOW,
    as_time_text,
    status_documents,
    table,
    text_of,
)
from descry.queries.registry import registered

_NOW = f"TIMESTAMP '{EVENTS_NOW}'"
_ORDERS_NOW = f"TIMESTAMP '{ORDERS_NOW}'"

# --- references --------------------------------------------------------------------------


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """Customers refer to their orders; orders with line items are known."""
    orders = table(spark, folder, "orders")
    to_orders = entry_weights(orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"])
    known = table(spark, folder, "lineitem").select("l_orderkey").distinct()
    edges = to_orders.select(
        text_of("C-", F.col("o_custkey")).alias("referencing"),
        text_of("O-", F.col("o_orderkey")).alias("referenced"),
        "weight",
        F.col("o_orderdate").cast("timestamp").alias("expires_at"),
    )
    own = known.select(
        text_of("O-", F.col("l_orderkey")).alias("referencing"),
        F.lit("").alias("referenced"),
        F.lit(0.0).alias("weight"),
        F.lit("2030-01-01").cast("timestamp").alias("expires_at"),
    )
    return edges.unionByName(own)


_MISSING_SQL = """
WITH edge AS (
  SELECT 'C-' || o_custkey AS referencing, 'O-' || o_orderkey AS referenced, o_orderkey,
         200.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey) AS weight FROM orders),
missing AS (SELECT * FROM edge e WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = e.o_orderkey)),
first AS (SELECT *, row_number() OVER (PARTITION BY referenced ORDER BY referencing) AS rn FROM missing)
"""


@registered(
    _MISSING_SQL
    + """SELECT referencing, referenced, round(weight, 6) AS weight,
           round(sum(CASE WHEN rn = 1 THEN weight ELSE 0 END) OVER (
             ORDER BY referencing, referenced ROWS UNBOUNDED PRECEDING), 6) AS running_weight FROM first"""
)
def missing_reference_list(spark: SparkSession, folder: str) -> DataFrame:
    """Edges to unknown documents with the running total of their weight."""
    return with_running_weight(missing_references(_edges(spark, folder))).select(
        "referencing",
        "referenced",
        F.round("weight", 6).alias("weight"),
        F.round("running_weight", 6).alias("running_weight"),
    )


@registered(
    _MISSING_SQL
    + """SELECT count(*) AS n_missing, round(sum(weight), 6) AS missing_weight,
                CASE WHEN sum(weight) > 0.999 THEN 'alert' ELSE 'ok' END AS state
         FROM first WHERE rn = 1"""
)
def missing_reference_weight(spark: SparkSession, folder: str) -> DataFrame:
    """Total weight of unknown documents, each counted once."""
    return missing_weight(missing_references(_edges(spark, folder))).select(
        "n_missing",
        F.round("missing_weight", 6).alias("missing_weight"),
        F.when(F.col("alert"), "alert").otherwise("ok").alias("state"),
    )


@registered(
    _MISSING_SQL
    + """SELECT referencing, referenced FROM edge JOIN orders USING (o_orderkey)
         WHERE o_orderdate >= TIMESTAMP '1998-06-01'"""
)
def unexpired_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that have not expired."""
    now = ORDERS_NOW.replace(year=1998, month=6, day=1, hour=0)
    return unexpired(_edges(spark, folder), now).filter("referenced <> ''").select(
        "referencing", "referenced"
    )


def _hour(column: str) -> Column:
    return F.date_trunc("hour", column)


_GRAPH_SQL = """
WITH e AS (SELECT *, date_trunc('hour', ts) AS h, strftime(date_trunc('hour', ts), '%Y-%m-%d-%H-%M-%S') AS va
           FROM events),
consensus_n AS (SELECT h, 200.0::DOUBLE / count(*) AS w FROM e WHERE event_type = 'click' GROUP BY h),
micro_n AS (SELECT h, 200.0::DOUBLE / count(*) AS w FROM e WHERE event_type = 'view' GROUP BY h),
vote_n AS (SELECT h, user_id % 4 AS v, 200.0::DOUBLE / count(*) AS w FROM e WHERE event_type = 'error' GROUP BY h, user_id % 4),
all_edges AS (
  SELECT 'C-' || va AS a, 'M-' || va AS b, 1.0::DOUBLE AS w, h + INTERVAL 3 HOUR AS x FROM e WHERE event_type = 'click'
  UNION ALL SELECT 'M-' || va, 'C-' || va, 1.0, h + INTERVAL 3 HOUR FROM e WHERE event_type = 'view'
  UNION ALL SELECT 'C-' || va, upper('V-' || va || '-v' || (user_id % 4)), 1.0, h + INTERVAL 3 HOUR FROM e WHERE event_type = 'click'
  UNION ALL SELECT 'C-' || va, upper('S-s' || user_id), w, ts + INTERVAL 3 HOUR FROM e JOIN consensus_n USING (h) WHERE event_type = 'click'
  UNION ALL SELECT 'M-' || va, upper('D-d' || user_id), w, ts + INTERVAL 3 HOUR FROM e JOIN micro_n USING (h) WHERE event_type = 'view'
  UNION ALL SELECT upper('V-' || va || '-v' || (user_id % 4)), upper('S-s' || user_id), w, ts + INTERVAL 6 HOUR
            FROM e JOIN vote_n n ON e.h = n.h AND e.user_id % 4 = n.v WHERE event_type = 'error'
  UNION ALL SELECT upper('S-s' || user_id), CASE WHEN user_id % 5 = 0 THEN '' ELSE upper('E-e' || user_id) END, 0.01,
            ts + INTERVAL 6 HOUR FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT upper('E-e' || user_id), '', 0.005, ts + INTERVAL 6 HOUR FROM e WHERE event_type = 'signup'
  UNION ALL SELECT DISTINCT upper('D-d' || user_id), '', 0.0, {now} + INTERVAL 30 DAY FROM e WHERE event_type = 'signup')
SELECT a AS referencing, b AS referenced, round(w, 6) AS weight, strftime(x, '%Y-%m-%d %H:%M:%S') AS expires
FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY x, w) AS rn FROM all_edges) WHERE rn = 1
"""


@registered(_GRAPH_SQL.replace("{now}", _NOW))
def reference_graph(spark: SparkSession, folder: str) -> DataFrame:
    """All kinds of reference edges between documents derived from events."""
    e = table(spark, folder, "events").withColumn("h", _hour("ts"))
    kind = F.when(F.col("event_type") == "click", "consensus").when(
        F.col("event_type") == "view", "consensus-microdesc"
    ).when(F.col("event_type") == "error", "vote")
    user, none = F.col("user_id"), F.lit(None).cast("string")
    vote = text_of("v", user % 4)
    documents = e.select(
        kind.alias("kind"),
        F.col("h").alias("valid_after"),
        F.when(kind == "vote", vote).alias("fingerprint"),
        F.when(kind == "consensus-microdesc", none).otherwise(text_of("s", user)).alias("server_digest"),
        F.when(kind == "consensus-microdesc", text_of("d", user)).alias("micro_digest"),
        F.col("ts").alias("published"),
    ).filter("kind is not null")
    statuses = documents.select("kind", "valid_after", "fingerprint").distinct()
    sources = e.filter("event_type = 'click'").select(
        F.lit("consensus").alias("kind"), F.col("h").alias("valid_after"), vote.alias("identity")
    ).distinct()
    servers = e.filter("event_type = 'purchase'").select(
        text_of("s", user).alias("digest"),
        F.when(user % 5 != 0, text_of("e", user)).alias("extra_info_digest"),
        F.col("ts").alias("published"),
    )
    signups = e.filter("event_type = 'signup'")
    extras = signups.select(text_of("e", user).alias("digest"), F.col("ts").alias("published"))
    micro = signups.select(text_of("d", user).alias("sha256_hex")).distinct()
    edges = reference_edges(statuses, sources, documents, servers, extras, micro, EVENTS_NOW)
    return edges.select(
        "referencing",
        "referenced",
        F.round("weight", 6).alias("weight"),
        as_time_text("expires_at").alias("expires"),
    )


_UNEXPIRED_AT = datetime(ORDERS_NOW.year - 1, 1, 1)


@registered(f"""
WITH entry AS (
  SELECT o_orderdate AS day, 'm' || o_orderkey || i AS m, i,
         CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 4 END AS n
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM orders WHERE o_orderpriority = '1-URGENT')
  WHERE NOT (o_orderstatus = 'P' AND i >= 3))
SELECT 'M-' || strftime(day, '%Y-%m-%d') || '-01-00-00' AS referencing,
       'D-' || upper(sha256(m)) AS referenced, 200.0::DOUBLE / n AS weight,
       strftime(day + INTERVAL 3 HOUR + to_minutes(i), '%Y-%m-%d %H:%M:%S') AS expires
FROM entry WHERE day + INTERVAL 3 HOUR + to_minutes(i) >= TIMESTAMP '{_UNEXPIRED_AT}'
""")
def unexpired_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of parsed statuses to microdescriptors that a later run still keeps."""
    statuses = parse_status(status_documents(spark, folder))
    keys = ["kind", "valid_after", "fingerprint"]
    nothing = lambda schema: spark.createDataFrame([], schema)
    edges = reference_edges(
        statuses.select(*keys),
        status_dir_sources(statuses),
        status_entries(statuses, keys),
        nothing("digest string, extra_info_digest string, published timestamp"),
        nothing("digest string, published timestamp"),
        nothing("sha256_hex string"),
        _UNEXPIRED_AT,
        to="D",
    )
    kept = unexpired(edges, _UNEXPIRED_AT)
    return kept.select(
        "referencing", "referenced", "weight", as_time_text("expires_at").alias("expires")
    )


# --- completeness ------------------------------------------------------------------------


def _completeness_inputs(spark: SparkSession, folder: str):
    """Statuses per order month; entries are orders and parts of line items."""
    orders, items = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "vote").otherwise("consensus")
    # an order refers to its server descriptor, a vote's third order to none
    entries = orders.select(
        kind.alias("kind"),
        month.alias("valid_after"),
        F.when(kind == "vote", text_of("v", F.col("o_custkey") % 3)).otherwise("").alias("fingerprint"),
        F.col("o_orderkey").cast("string").alias("server_digest"),
        F.when(kind == "consensus", (F.col("o_orderkey") % 977).cast("string")).alias("micro_digest"),
    )
    servers = items.select(
        F.col("l_orderkey").cast("string").alias("digest"),
        F.col("l_partkey").cast("string").alias("extra_info_digest"),
    )
    extras = table(spark, folder, "part").filter("p_size > 2").select(
        F.col("p_partkey").cast("string").alias("digest")
    )
    micro = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("sha256_hex"))
    return entries, servers, extras, micro


_COMPLETE_SQL = """
WITH entry AS (
  SELECT CASE o_orderpriority WHEN '5-LOW' THEN 'vote' ELSE 'consensus' END AS kind,
         date_trunc('month', o_orderdate) AS va,
         CASE o_orderpriority WHEN '5-LOW' THEN 'v' || (o_custkey % 3) ELSE '' END AS fp,
         o_orderkey, o_orderkey % 977 AS micro FROM orders),
server AS (SELECT l_orderkey, max(CAST(l_partkey AS VARCHAR)) AS extra FROM lineitem GROUP BY l_orderkey),
extra AS (SELECT CAST(p_partkey AS VARCHAR) AS extra FROM part WHERE p_size > 2),
s AS (
  SELECT kind, va, fp, count(*) AS all_s, count(server.l_orderkey) AS found_s,
         count(server.extra) AS all_e, count(extra.extra) AS found_e
  FROM entry LEFT JOIN server ON server.l_orderkey = entry.o_orderkey LEFT JOIN extra ON extra.extra = server.extra
  GROUP BY kind, va, fp),
m AS (
  SELECT kind, va, fp, count(*) AS all_m, count(c_custkey) AS found_m
  FROM (SELECT DISTINCT kind, va, fp, micro FROM entry WHERE kind = 'consensus') LEFT JOIN customer ON c_custkey = micro
  GROUP BY kind, va, fp),
counts AS (
  SELECT s.*, coalesce(all_m, 0) AS all_m, coalesce(found_m, 0) AS found_m
  FROM s LEFT JOIN m ON s.kind = m.kind AND s.va = m.va AND s.fp = m.fp)
"""
_COUNTS = ("all_s", "found_s", "all_e", "found_e", "all_m", "found_m")


@registered(
    _COMPLETE_SQL
    + """SELECT kind, strftime(va, '%Y-%m-%d') AS valid_after, fp AS fingerprint, all_s, found_s, all_e, found_e,
           all_m, found_m, round(found_s * 100.0::DOUBLE / all_s, 1) AS percent_s FROM counts"""
)
def status_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Found and referenced descriptors per status."""
    counts = completeness(*_completeness_inputs(spark, folder))
    return counts.select(
        "kind",
        F.date_format("valid_after", "yyyy-MM-dd").alias("valid_after"),
        "fingerprint",
        *_COUNTS,
        percent(F.col("found_s"), F.col("all_s")).alias("percent_s"),
    )


@registered(
    _COMPLETE_SQL
    + """, votes AS (SELECT va, count(DISTINCT fp) AS found_v FROM entry WHERE kind = 'vote' GROUP BY va)
     SELECT c.kind, strftime(c.va, '%Y-%m-%d') AS valid_after, c.fp AS fingerprint,
       CASE WHEN found_s * 1000 < all_s * 995 OR found_e * 1000 < all_e * 995 OR found_m * 1000 < all_m * 995
            THEN 1 ELSE 0 END AS missing_descriptors,
       CASE WHEN c.kind = 'consensus' AND coalesce(found_v, 0) < 4 THEN 1 ELSE 0 END AS missing_votes,
       CASE WHEN c.kind = 'consensus' THEN 1 ELSE 0 END AS missing_micro
     FROM counts c LEFT JOIN votes v ON v.va = c.va"""
)
def completeness_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags per status, all of them taken as newly stored."""
    inputs = _completeness_inputs(spark, folder)
    entries = inputs[0]
    statuses = entries.select("kind", "valid_after", "fingerprint").distinct()
    expected = statuses.select("valid_after").distinct().withColumn("expected_votes", F.lit(4))
    report = completeness_report(
        completeness(*inputs),
        statuses.filter("kind = 'vote'"),
        expected,
        statuses,
        ORDERS_NOW.replace(year=1990),
    )
    flags = ("missing_descriptors", "missing_votes", "missing_microdesc_consensus")
    return report.select(
        "kind",
        F.date_format("valid_after", "yyyy-MM-dd").alias("valid_after"),
        "fingerprint",
        *[F.col(f).cast("int").alias(f.replace("microdesc_consensus", "micro")) for f in flags],
    )


# --- work list -------------------------------------------------------------------------------

_KEY_SQL = """
  CASE event_type WHEN 'click' THEN 'server' WHEN 'view' THEN 'server' WHEN 'signup' THEN 'extra'
       WHEN 'purchase' THEN 'micro' ELSE 'vote' END AS type,
  CASE event_type WHEN 'error' THEN date_trunc('hour', ts) ELSE ts END AS time,
  'r' || user_id AS relay_id,
  CASE event_type WHEN 'purchase' THEN 'd' || (user_id % 17) ELSE 'd' || event_id END AS digest
"""
_WORK_SQL = f"""
WITH k AS (SELECT {_KEY_SQL}, value, ts FROM events),
w AS (
  SELECT * FROM k WHERE (type IN ('server', 'extra', 'micro') AND time > {_NOW} - INTERVAL 30 HOUR)
     OR (type = 'vote' AND time = date_trunc('hour', {_NOW}))),
state AS (SELECT *, CASE WHEN value < 15 THEN ts END AS old FROM w WHERE value < 30),
merged AS (
  SELECT type, time, relay_id, digest, max(old) AS old, max(new) AS new, max(ref) AS ref FROM (
    SELECT type, time, relay_id, digest, old, NULL::TIMESTAMP AS new, 0 AS ref FROM state
    UNION ALL SELECT type, time, relay_id, digest, NULL, NULL, 1 FROM w
    UNION ALL SELECT type, time, relay_id, digest, NULL, {_NOW}, 0 FROM w WHERE value > 80 AND type <> 'micro')
  GROUP BY ALL),
same AS (SELECT digest, strftime(time, '%Y-%m') AS mon, max(old) AS same FROM state
         WHERE type = 'micro' AND old IS NOT NULL GROUP BY ALL),
seen_micro AS (SELECT DISTINCT digest FROM k WHERE type = 'micro' AND value > 98),
work AS (
  SELECT m.type, m.time, m.relay_id, m.digest,
         CASE WHEN m.type <> 'micro' THEN coalesce(new, old)
              WHEN s.digest IS NOT NULL THEN {_NOW}
              ELSE coalesce(new, old, CASE WHEN ref = 1 THEN same.same END) END AS parsed_at
  FROM merged m LEFT JOIN same ON same.digest = m.digest AND same.mon = strftime(m.time, '%Y-%m')
       LEFT JOIN seen_micro s ON s.digest = m.digest)
"""


def _work(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    t = F.col("event_type")
    type_ = (
        F.when(t.isin("click", "view"), "server")
        .when(t == "signup", "extra")
        .when(t == "purchase", "micro")
        .otherwise("vote")
    )
    keys = e.select(
        type_.alias("type"),
        F.when(t == "error", _hour("ts")).otherwise(F.col("ts").cast("timestamp")).alias("time"),
        text_of("r", F.col("user_id")).alias("relay_id"),
        F.when(t == "purchase", text_of("d", F.col("user_id") % 17))
        .otherwise(text_of("d", F.col("event_id")))
        .alias("digest"),
        "value",
        F.col("ts").cast("timestamp").alias("ts"),
    )
    state = keys.filter("value < 30").withColumn("parsed_at", F.expr("CASE WHEN value < 15 THEN ts END"))
    seen = keys.filter("value > 80 AND type <> 'micro'")
    seen_micro = keys.filter("type = 'micro' AND value > 98").select("digest")
    return update_missing(state, keys, seen, EVENTS_NOW, seen_micro)


@registered(
    _WORK_SQL
    + """SELECT type, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, relay_id, digest,
           coalesce(strftime(parsed_at, '%Y-%m-%d %H:%M:%S'), 'NA') AS parsed_at FROM work"""
)
def missing_worklist(spark: SparkSession, folder: str) -> DataFrame:
    """The work list after referenced and seen keys were merged in."""
    return _work(spark, folder).select(
        "type",
        as_time_text("time").alias("time"),
        "relay_id",
        "digest",
        F.coalesce(as_time_text("parsed_at"), F.lit("NA")).alias("parsed_at"),
    )


@registered(
    _WORK_SQL
    + """SELECT type, count(DISTINCT CASE WHEN type = 'micro' THEN digest
                 ELSE CAST(time AS VARCHAR) || relay_id || digest END) AS n_missing
         FROM work WHERE parsed_at IS NULL GROUP BY type"""
)
def missing_key_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Still missing per type; microdescriptors by distinct digest."""
    return missing_counts(_work(spark, folder))


# --- staleness and retention ---------------------------------------------------------------------


@registered(f"""
SELECT event_type AS kind, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest,
       CASE WHEN max(ts) < {_NOW} - CASE event_type WHEN 'error' THEN INTERVAL 48 HOUR ELSE INTERVAL 330 MINUTE END
            THEN 'stale' ELSE 'fresh' END AS state
FROM (SELECT event_type, ts - INTERVAL 1 HOUR * (event_id % 7) AS ts FROM events) GROUP BY event_type
""")
def latest_per_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Latest time per kind and whether it lies too far back."""
    hours = F.make_dt_interval(hours=(F.col("event_id") % 7).cast("int"))
    seen = table(spark, folder, "events").withColumn("ts", F.col("ts") - hours)
    latest = latest_and_stale(
        seen, EVENTS_NOW, "event_type", "ts", after_by_type={"error": timedelta(hours=48)}
    )
    return latest.select(
        F.col("event_type").alias("kind"),
        as_time_text("latest").alias("latest"),
        F.when(F.col("stale"), "stale").otherwise("fresh").alias("state"),
    )


@registered(f"""
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_scan,
       CASE WHEN max(ts) < {_NOW} - INTERVAL 330 MINUTE THEN 'stale' ELSE 'fresh' END AS state
FROM events GROUP BY user_id
""")
def last_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Last scan per list."""
    scans = max_scan_time(table(spark, folder, "events"), ["user_id"], "ts", EVENTS_NOW)
    return scans.select(
        "user_id",
        as_time_text("last_scan").alias("last_scan"),
        F.when(F.col("stale"), "stale").otherwise("fresh").alias("state"),
    )


@registered(f"""
SELECT event_id, 'recent' AS store FROM events WHERE ts >= {_NOW} - INTERVAL 3 DAY OR event_type = 'signup'
UNION ALL SELECT event_id, 'archive' FROM events WHERE ts >= {_NOW} - INTERVAL 49 DAY
""")
def retained_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Three days of recent rows (signups exempt) and 49 days of archive."""
    e = table(spark, folder, "events")
    exempt = F.col("event_type") == "signup"
    recent = retention(e, "ts", EVENTS_NOW, timedelta(days=3), exempt)
    archive = retention(e, "ts", EVENTS_NOW, timedelta(days=49))
    return recent.select("event_id", F.lit("recent").alias("store")).unionByName(
        archive.select("event_id", F.lit("archive").alias("store"))
    )


@registered(f"""
WITH a AS (SELECT 'auth' || user_id AS authority, max(ts) AS last FROM events GROUP BY user_id)
SELECT authority FROM a WHERE last < {_NOW} - INTERVAL '23 hours 30 minutes' ORDER BY authority LIMIT 2
""")
def refresh_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """At most two authorities whose full refresh is due."""
    authorities = (
        table(spark, folder, "events")
        .groupBy(text_of("auth", F.col("user_id")).alias("authority"))
        .agg(F.max("ts").alias("last_refresh"))
    )
    return throttle_full_refresh(authorities, EVENTS_NOW).select("authority")
