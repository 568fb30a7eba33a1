"""Documents of landed lists, timings and statistics, and what is rejected with which reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.formats import DISTRIBUTOR_METRICS_END
from descry.plans.derived import (
    as_time_text,
    documents_table,
    hex_id,
    made_once,
    table,
    text_of,
    utf8,
)
from descry.plans.listings import (
    analysis_documents,
    exit_list_documents,
    pool_documents,
    statistics_documents,
    timing_documents,
)
from descry.queries.registry import registered


def _day(time: Column | str = "ts") -> Column:
    return F.date_format(F.col(time).cast("timestamp") if isinstance(time, str) else time, "yyyy-MM-dd")


@registered("""
WITH f AS (
  SELECT event_id, CASE event_type WHEN 'signup' THEN 'x/2024-13-01.op.onionperf.analysis.json.xz'
           ELSE 'op-' || user_id || '/' || strftime(ts, '%Y-%m-%d') || '.onionperf.analysis.json.xz' END AS path,
         event_type, user_id, value > 50 AS two, ts FROM events)
SELECT event_id, CASE event_type WHEN 'signup' THEN 'op' ELSE 'op-' || user_id END AS source,
       CASE event_type WHEN 'signup' THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day,
       CASE WHEN event_type IN ('error', 'view') THEN 0 WHEN two THEN 2 ELSE 1 END AS n_transfers,
       CASE WHEN event_type = 'signup' THEN 'invalid file name'
            WHEN event_type = 'error' THEN 'unreadable'
            WHEN event_type = 'view' AND two THEN 'no analysis'
            WHEN event_type <> 'view' AND event_id % 4 = 0 THEN 'transfer of another source' END AS reason
FROM f
""")
def transfer_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Analyses by file: source and date of their name, number of transfers, why rejected.

    A source without a transfer is nobody's; text that is no JSON is no analysis.
    """
    kind, own = F.col("event_type"), text_of("op-", F.col("user_id"))
    two = F.col("value") > 50
    transfers = F.concat(
        F.lit('{"t1":{"filesize_bytes":5}'), F.when(two, ',"t2":{}').otherwise(""), F.lit("}")
    )
    foreign = F.when(F.col("event_id") % 4 == 0, F.lit("other"))
    source = F.coalesce(foreign, F.when(kind == "signup", "op").otherwise(own))
    body = lambda name, found: F.concat(
        F.lit('{"data":{"'), name, F.lit('":{"tgen":{"transfers":'), found, F.lit("}}}}")
    )
    text = (
        F.when(kind == "error", None)
        .when((kind == "view") & two, "{no json")
        .when(kind == "view", body(source, F.lit("{}")))
        .otherwise(body(source, transfers))
    )
    day = _day()
    path = F.when(kind == "signup", "x/2024-13-01.op.onionperf.analysis.json.xz").otherwise(
        F.concat(own, F.lit("/"), day, F.lit(".onionperf.analysis.json.xz"))
    )
    files = table(spark, folder, "events").select(
        "event_id", path.alias("path"), text.alias("text")
    )
    # the operator keeps only its own columns, so the file's name carries the row's number
    numbered = F.concat(F.col("event_id").cast("string"), F.lit("#/"), F.col("path"))
    unpacked = files.select(
        numbered.alias("path"),
        utf8(F.col("text")).alias("content"),
        "text",
        F.when(F.col("text").isNull(), "damaged").alias("error"),
    )
    return analysis_documents(unpacked).select(
        F.substring_index("path", "#", 1).cast("long").alias("event_id"),
        "source",
        _day(F.col("published")).alias("day"),
        "n_transfers",
        "reason",
    )


@registered("""
WITH t AS (SELECT event_id, ts, event_type, unnest([1, 2, 3]) AS pos FROM events)
SELECT event_id, CAST(CASE WHEN pos = 3 THEN 0 ELSE pos END AS INT) AS pos,
       CASE WHEN pos = 3 OR (event_type = 'error' AND pos = 2) THEN NULL
            ELSE strftime(ts + INTERVAL 1 DAY * (pos - 1), '%Y-%m-%d %H:%M:%S') END AS metrics_end,
       CASE WHEN pos = 3 OR (event_type = 'error' AND pos = 2) THEN 'no statistics' END AS reason
FROM t WHERE pos < 3 OR event_type = 'purchase'
""")
def distributor_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics documents of texts with two of them, and what else the texts hold."""
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp")

    def document(time: Column) -> Column:
        return text_of(
            f"@type bridgedb-metrics 1.0\n{DISTRIBUTOR_METRICS_END} ", time, " (86400 s)\n",
            "bridgedb-metrics-version 2\n",
        )

    second = F.when(kind == "error", "no time").otherwise(
        as_time_text(ts + F.make_dt_interval(days=F.lit(1)))
    )
    before = F.when(kind == "purchase", "router x\n").otherwise("")
    texts = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("path"),
        F.concat(before, document(as_time_text(ts)), document(second)).alias("text"),
    )
    return statistics_documents(made_once(texts, "text"), DISTRIBUTOR_METRICS_END).select(
        F.col("path").cast("long").alias("event_id"),
        "pos",
        as_time_text("published").alias("metrics_end"),
        "reason",
    )


@registered("""
SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE 51200 END AS size,
       CASE WHEN event_type = 'signup' THEN 'invalid file name'
            WHEN event_type = 'error' THEN 'no timings'
            WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'other than timings'
            WHEN event_id % 3 = 0 OR (event_type = 'click' AND date_diff('day', CAST(ts AS DATE), CAST(ts + INTERVAL 3 HOUR AS DATE)) > 0)
              THEN 'differs from file name' END AS reason
FROM events
""")
def timing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of timings: why one is rejected; any row that disagrees with the name does it."""
    kind, ts, user = F.col("event_type"), F.col("ts").cast("timestamp"), F.col("user_id")
    row = lambda size, time: text_of(
        "SOURCE=s", user, " FILESIZE=", size, " START=", F.unix_timestamp(time), ".50\n"
    )
    late = F.when(kind == "click", ts + F.make_dt_interval(hours=F.lit(3))).otherwise(ts)
    size = F.when(F.col("event_id") % 3 == 0, 1).otherwise(51200)
    other = F.when((kind == "purchase") & (F.col("event_id") % 2 == 0), "router x\n").otherwise("")
    rows = F.concat(row(F.lit(51200), ts), row(size, late), other)
    text = F.concat(F.lit("@type torperf 1.1\n"), F.when(kind == "error", "").otherwise(rows))
    path = F.concat(
        F.col("event_id").cast("string"), F.lit("#/s"), user.cast("string"),
        F.when(kind == "signup", "-x-").otherwise("-51200-"), _day(), F.lit(".tpf"),
    )
    files = table(spark, folder, "events").select(path.alias("path"), utf8(text).alias("content"))
    return timing_documents(files).select(
        F.substring_index("path", "#", 1).cast("long").alias("event_id"), "size", "reason"
    )


@registered("""
WITH l AS (
  SELECT o_orderkey, o_orderstatus, sha1('a' || o_custkey) AS f, 'moat' AS d FROM orders
  UNION ALL SELECT o_orderkey, o_orderstatus, sha1('b' || o_custkey), 'https ring=2' FROM orders),
h AS (SELECT o_orderkey, o_orderstatus, sha1(unhex(f)) || ' ' || d || chr(10) AS line FROM l)
SELECT CAST(o_orderkey AS VARCHAR) AS path, '2016-04-09 00:29:37' AS published,
       CASE WHEN o_orderstatus <> 'F' THEN sha256('@type bridge-pool-assignment 1.0' || chr(10)
         || 'bridge-pool-assignment 2016-04-09 00:29:37' || chr(10) || string_agg(line, '' ORDER BY line)) END AS sha256,
       CASE WHEN o_orderstatus = 'F' THEN 'fingerprint is no hex' END AS reason
FROM h GROUP BY o_orderkey, o_orderstatus
""")
def pool_files(spark: SparkSession, folder: str) -> DataFrame:
    """Sanitized documents of pool assignments, sorted by what the fingerprints became."""
    c = F.col("o_custkey")
    odd = F.when(F.col("o_orderstatus") == "F", text_of("z" * 40, " moat\n")).otherwise("")
    text = F.concat(
        text_of("bridge-pool-assignment 2016-04-09 00:29:37\n", hex_id("b", c), " https ring=2\n"),
        text_of(F.lower(hex_id("a", c)), " email\n", F.lower(hex_id("a", c)), " moat\n"),
        odd,
    )
    orders = documents_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    texts = orders.select(F.col("o_orderkey").cast("string").alias("path"), text.alias("text"))
    return pool_documents(made_once(texts, "text")).select(
        "path", as_time_text("published").alias("published"), F.sha2("raw", 256).alias("sha256"), "reason"
    )


@registered("""
SELECT c_custkey,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL
            WHEN c_mktsegment = 'HOUSEHOLD' THEN '2016-09-21 00:00:00' ELSE '2016-09-20 13:02:00' END AS published,
       '2016-09-19 03:02:00' AS latest,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'not one exit list'
            WHEN c_mktsegment = 'MACHINERY' THEN 'no time of download' END AS reason
FROM customer
""")
def exit_list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Exit lists by file: time, last scan, why rejected; a plain one gets the time it arrived."""
    segment = F.col("c_mktsegment")
    node = lambda i: text_of(
        "ExitNode ", hex_id("n", F.col("c_custkey"), str(i)), "\nPublished 2016-09-19 01:02:03\n",
        f"LastStatus 2016-09-19 02:00:00\nExitAddress 10.0.0.{i} 2016-09-19 03:0{i}:00\n",
    )
    time = F.when(segment == "MACHINERY", "yesterday").otherwise("2016-09-20 13:02:00")
    head = F.when(segment == "HOUSEHOLD", "").otherwise(
        text_of("@type tordnsel 1.0\nDownloaded ", time, "\n")
    )
    foreign = F.when(segment == "BUILDING", "other 1\n").otherwise("")
    texts = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("path"),
        F.concat(head, node(2), node(1), foreign).alias("text"),
        F.lit("2016-09-21 00:00:00").cast("timestamp").alias("modificationTime"),
    )
    return exit_list_documents(texts).select(
        F.col("path").cast("long").alias("c_custkey"),
        as_time_text("published").alias("published"),
        as_time_text("latest").alias("latest"),
        "reason",
    )
