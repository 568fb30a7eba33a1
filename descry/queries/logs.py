"""Access-log operators on ``events`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.operators.access_logs import (
    HOSTS,
    dates_not_stored,
    expand_counts,
    files_to_reprocess,
    parse_log_path,
    safe_dates,
    strip_query,
)
from descry.operators.keys import merge_counts
from descry.plans.access_logs import lines_to_counts
from descry.plans.derived import log_lines, table, text_of
from descry.queries.registry import registered

# sanitized lines, written without any parsing
_LINES_SQL = """
WITH kept AS (
  SELECT 'host' || (user_id % 3) || '.example.org' AS virtual_host,
         'web' || (user_id % 2) AS physical_host,
         'logs/web' || (user_id % 2) || '/log-' || user_id AS path,
         CAST(ts AS DATE) AS d,
         '0.0.0.0 - - [' || strftime(ts, '%d/%b/%Y') || ':00:00:00 +0000] "'
           || CASE event_type WHEN 'view' THEN 'HEAD' ELSE 'GET' END || ' /' || event_type
           || ' HTTP/1.1" 200 '
           || CASE WHEN user_id % 7 = 0 THEN '-'
                   ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS line
  FROM events WHERE event_type IN ('click', 'view'))
"""
_RANKED_SQL = """
, days AS (SELECT DISTINCT virtual_host, physical_host, d FROM kept),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY virtual_host, physical_host ORDER BY d) AS up,
         row_number() OVER (PARTITION BY virtual_host, physical_host ORDER BY d DESC) AS down
  FROM days)
"""


@registered(
    _LINES_SQL
    + """SELECT virtual_host, physical_host, strftime(d, '%Y-%m-%d') AS log_date, line,
                count(*) AS n FROM kept GROUP BY ALL"""
)
def access_log_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Parse, sanitize and count log lines."""
    return lines_to_counts(log_lines(spark, folder)).withColumn(
        "log_date", F.col("log_date").cast("string")
    )


@registered(
    _LINES_SQL
    + _RANKED_SQL
    + """SELECT virtual_host, physical_host, strftime(d, '%Y-%m-%d') AS log_date, 'limits' AS mode
         FROM ranked WHERE up > 1 AND down > 2
         UNION ALL
         SELECT virtual_host, physical_host, strftime(d, '%Y-%m-%d'), 'all' FROM days"""
)
def safe_log_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days that are safe to store, with and without limits."""
    counts = lines_to_counts(log_lines(spark, folder))
    both = [
        safe_dates(counts, limits).withColumn("mode", F.lit(mode))
        for limits, mode in ((True, "limits"), (False, "all"))
    ]
    return both[0].unionByName(both[1]).withColumn("log_date", F.col("log_date").cast("string"))


@registered("""
WITH counts AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS bucket, count(*) AS n
                FROM events GROUP BY ALL)
SELECT event_type, bucket, unnest(range(1, n + 1)) AS copy FROM counts
""")
def expand_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Repeat each counted line as often as it was counted."""
    counts = (
        table(spark, folder, "events")
        .groupBy("event_type", F.floor("value").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return expand_counts(counts, lines_per_chunk=100).select("event_type", "bucket", "copy")


@registered("""
SELECT page_id, CASE WHEN strpos(url, '?') > 1 THEN substr(url, 1, strpos(url, '?') - 1)
                     ELSE url END AS request FROM pages
""")
def strip_request_query(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", strip_query(F.col("url")).alias("request"))


@registered("""
SELECT o_orderkey, 'vh' || (o_custkey % 9) AS virtual_host, 'ph' || (o_orderkey % 4) AS physical_host,
       strftime(o_orderdate, '%Y-%m-%d') AS file_date, 'gz' AS file_type
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def log_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts and dates from log paths; malformed names and dates are dropped."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = (
        F.when(F.col("o_orderpriority") == "1-URGENT", text_of("-access.log-", day, ".gz"))
        .when(F.col("o_orderpriority") == "2-HIGH", text_of("-access.log-", day, "gz"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", text_of("-access.log-", day, ".g-z"))
        .when(F.col("o_orderpriority") == "5-LOW", text_of("-access.log-20161332.gz"))
        .otherwise(text_of("-error.log-", day, ".gz"))
    )
    paths = table(spark, folder, "orders").select(
        "o_orderkey",
        text_of("/in/ph", F.col("o_orderkey") % 4, "/vh", F.col("o_custkey") % 9, name).alias("path"),
    )
    return (
        parse_log_path(paths)
        .withColumn("file_date", F.col("file_date").cast("string"))
        .drop("path")
    )


@registered(
    _LINES_SQL
    + _RANKED_SQL
    + """, store AS (SELECT virtual_host, physical_host, d FROM ranked WHERE up > 1 AND down > 2)
         SELECT DISTINCT k.virtual_host, k.physical_host, k.path FROM kept k
         JOIN store s ON k.virtual_host = s.virtual_host AND k.physical_host = s.physical_host
                     AND k.d = s.d"""
)
def log_files_to_reprocess(spark: SparkSession, folder: str) -> DataFrame:
    """Files that hold a date about to be stored."""
    counts = lines_to_counts(log_lines(spark, folder), "path")
    processed = counts.select(*HOSTS, "log_date", "path").distinct()
    return files_to_reprocess(processed, safe_dates(counts))


@registered(
    _LINES_SQL
    + """, days AS (SELECT DISTINCT virtual_host, physical_host, d FROM kept),
     stored AS (SELECT DISTINCT 'host' || (user_id % 3) || '.example.org' AS virtual_host,
                       'web' || (user_id % 2) AS physical_host, CAST(ts AS DATE) AS d
                FROM events WHERE event_type = 'signup' AND value > 60)
     SELECT virtual_host, physical_host, strftime(d, '%Y-%m-%d') AS log_date FROM days
     WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.virtual_host = days.virtual_host
                       AND s.physical_host = days.physical_host AND s.d = days.d)"""
)
def log_dates_not_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Dates without a stored day; a day with a large signup counts as stored."""
    user = F.col("user_id")
    archive = (
        table(spark, folder, "events")
        .filter((F.col("event_type") == "signup") & (F.col("value") > 60))
        .select(
            text_of("host", user % 3, ".example.org").alias("virtual_host"),
            text_of("web", user % 2).alias("physical_host"),
            F.to_date("ts").alias("log_date"),
        )
    )
    dates = safe_dates(lines_to_counts(log_lines(spark, folder)), limits=False)
    return dates_not_stored(dates, archive).withColumn("log_date", F.col("log_date").cast("string"))


@registered("""
SELECT user_id, CAST(count(*) + 10 * count(CASE WHEN event_type = 'click' THEN 1 END) AS BIGINT) AS n
FROM events GROUP BY user_id
""")
def merged_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per-key counts of several files added up."""
    e = table(spark, folder, "events")
    everything = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    clicks = e.filter(F.col("event_type") == "click").groupBy("user_id").agg(
        (F.count(F.lit(1)) * 10).alias("n")
    )
    return merge_counts([everything, clicks], ["user_id"])
