"""Pseudonyms for addresses, ports and fingerprints on ``events`` and others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.functions.scrub import (
    grouped_by_four,
    hash_fingerprint,
    ipv6_hex,
    scrub_ipv4,
    scrub_ipv6,
    scrub_or_address,
    scrub_tcp_port,
)
from descry.operators.sanitize import sanitize_pool_assignments
from descry.operators.secrets import month_of, months_needing_secret, with_month_secret
from descry.plans.derived import (
    addresses,
    documents_table,
    hex_id,
    month_secret,
    secrets_for,
    table,
    text_of,
)
from descry.queries.registry import registered

SECRET_SQL = (
    "substr(upper(sha256('a' || m) || sha256('b' || m) || sha256('c' || m)), 1, 166)"
)
# addresses, fingerprint and secret as hex, then the three digests
SCRUB_SQL = f"""
WITH base AS (
  SELECT event_id, event_type, user_id, strftime(ts, '%Y-%m') AS m,
         user_id * 401 % 65536 AS port,
         printf('%02x%02x%02x%02x', 10, user_id % 256, (event_id // 256) % 256, event_id % 256) AS ip4,
         '20010db8' || repeat('0', 16) || printf('%04x%04x', user_id % 65536, event_id % 65536) AS ip6,
         sha1('fp' || user_id) AS fp FROM events),
keyed AS (SELECT *, {SECRET_SQL} AS sec FROM base),
digests AS (
  SELECT *, sha256(unhex(ip4 || fp || substr(sec, 1, 62))) AS d4,
         sha256(unhex(ip6 || fp || substr(sec, 63, 38))) AS d6,
         sha256(unhex(printf('%04x', port) || fp || substr(sec, 101, 66))) AS dp FROM keyed),
scrubbed AS (
  SELECT *, '10.' || CAST(CAST('0x' || substr(d4, 1, 2) AS INT) AS VARCHAR) || '.'
              || CAST(CAST('0x' || substr(d4, 3, 2) AS INT) AS VARCHAR) || '.'
              || CAST(CAST('0x' || substr(d4, 5, 2) AS INT) AS VARCHAR) AS ipv4,
         '[fd9f:2e19:3bcf::' || substr(d6, 59, 2) || ':' || substr(d6, 61, 4) || ']' AS ipv6,
         CASE WHEN port = 0 THEN '0' ELSE CAST(
           (CAST('0x' || substr(dp, 1, 4) AS INT) // 4) | 49152 AS VARCHAR) END AS port_out
  FROM digests)
"""


def _with_secret(spark: SparkSession, folder: str) -> DataFrame:
    rows = addresses(spark, folder)
    months = rows.select(month_of(F.col("published")).alias("month"))
    return with_month_secret(rows, secrets_for(months))


@registered(SCRUB_SQL + "SELECT event_id, ipv4 AS scrubbed FROM scrubbed")
def scrubbed_ipv4(spark: SparkSession, folder: str) -> DataFrame:
    return _with_secret(spark, folder).select(
        "event_id", scrub_ipv4(F.col("ipv4"), F.col("fingerprint"), F.col("secret")).alias("scrubbed")
    )


@registered(SCRUB_SQL + "SELECT event_id, ip6 AS expanded, ipv6 AS scrubbed FROM scrubbed")
def scrubbed_ipv6(spark: SparkSession, folder: str) -> DataFrame:
    return _with_secret(spark, folder).select(
        "event_id",
        ipv6_hex(F.col("ipv6")).alias("expanded"),
        scrub_ipv6(F.col("ipv6"), F.col("fingerprint"), F.col("secret")).alias("scrubbed"),
    )


@registered(SCRUB_SQL + "SELECT event_id, port_out AS scrubbed FROM scrubbed")
def scrubbed_port(spark: SparkSession, folder: str) -> DataFrame:
    return _with_secret(spark, folder).select(
        "event_id",
        scrub_tcp_port(F.col("port"), F.col("fingerprint"), F.col("secret")).alias("scrubbed"),
    )


@registered(
    SCRUB_SQL
    + """SELECT event_id, CASE event_type WHEN 'click' THEN ipv4 || ':' || port_out
                WHEN 'view' THEN ipv6 || ':' || port_out ELSE 'malformed' END AS scrubbed,
                CASE WHEN event_type = 'click' THEN '127.0.0.1:' || CASE WHEN port = 0 THEN '0' ELSE '1' END
                     WHEN event_type = 'view'
                     THEN '[fd9f:2e19:3bcf::]:' || CASE WHEN port = 0 THEN '0' ELSE '1' END
                     ELSE 'malformed' END AS unkeyed FROM scrubbed"""
)
def scrubbed_or_address(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses with ports, hashed and not; those without a port are malformed."""
    kind = table(spark, folder, "events").select("event_id", "event_type")
    rows = _with_secret(spark, folder).join(kind, "event_id")
    address = (
        F.when(F.col("event_type") == "click", text_of(F.col("ipv4"), ":", F.col("port")))
        .when(F.col("event_type") == "view", text_of(F.col("ipv6"), ":", F.col("port")))
        .otherwise(F.col("ipv4"))
    )
    fp, none = F.col("fingerprint"), F.lit("malformed")
    return rows.select(
        "event_id",
        F.coalesce(scrub_or_address(address, fp, F.col("secret")), none).alias("scrubbed"),
        F.coalesce(scrub_or_address(address, fp), none).alias("unkeyed"),
    )


_TEXT_MONTH = "2020-01"
_QUAD = r"([0-9]{1,3}\.){3}[0-9]{1,3}"


@registered(f"""
WITH found AS (
  SELECT doc_id, '{_TEXT_MONTH}' AS m,
         unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '{_QUAD}'))) AS address
  FROM documents),
parts AS (SELECT *, list_transform(string_split(address, '.'), lambda x: CAST(x AS INT)) AS o FROM found),
digests AS (
  SELECT *, CASE WHEN list_max(o) < 256 THEN
    sha256(unhex(printf('%02x%02x%02x%02x', o[1], o[2], o[3], o[4]) || sha1('fp' || doc_id)
                 || substr({SECRET_SQL}, 1, 62))) END AS d
  FROM parts)
SELECT doc_id, address, coalesce('10.' || CAST(CAST('0x' || substr(d, 1, 2) AS INT) AS VARCHAR) || '.'
         || CAST(CAST('0x' || substr(d, 3, 2) AS INT) AS VARCHAR) || '.'
         || CAST(CAST('0x' || substr(d, 5, 2) AS INT) AS VARCHAR), 'malformed') AS scrubbed
FROM digests
""")
def scrubbed_text_ips(spark: SparkSession, folder: str) -> DataFrame:
    """Pseudonyms of the different addresses in whole texts."""
    found = documents_table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id",
        F.explode(
            F.array_distinct(F.regexp_extract_all("text", F.lit(_QUAD), F.lit(0)))
        ).alias("address"),
    )
    scrubbed = scrub_ipv4(
        F.col("address"), hex_id("fp", F.col("doc_id")), month_secret(F.lit(_TEXT_MONTH))
    )
    return found.select(
        "doc_id", "address", F.coalesce(scrubbed, F.lit("malformed")).alias("scrubbed")
    )


@registered("""
SELECT c_custkey, rtrim(regexp_replace(upper(sha1(unhex(sha1('fp' || c_custkey)))), '(.{4})', '\\1 ', 'g'))
  AS hashed FROM customer
""")
def hashed_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        "c_custkey",
        grouped_by_four(hash_fingerprint(hex_id("fp", F.col("c_custkey")))).alias("hashed"),
    )


@registered("""
WITH rows AS (SELECT o_orderkey, 'file' || (o_orderkey % 2) AS path, o_orderdate AS d, o_orderstatus,
                     o_totalprice, sha1('fp' || o_custkey) AS fp FROM orders),
bad AS (SELECT DISTINCT path, d FROM rows WHERE o_orderstatus = 'P' AND o_totalprice > 450000)
SELECT o_orderkey, path, strftime(d, '%Y-%m-%d %H:%M:%S') AS published, sha1(unhex(fp)) AS hashed_fingerprint
FROM rows WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.d = rows.d AND bad.path = rows.path)
""")
def sanitized_pool_assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed fingerprints; one undecodable one rejects its file's whole group of a time."""
    damaged = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 450000)
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        text_of("file", F.col("o_orderkey") % 2).alias("path"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("published"),
        F.when(damaged, "zz").otherwise(hex_id("fp", F.col("o_custkey"))).alias("fingerprint"),
    )
    return sanitize_pool_assignments(rows)


@registered("""
WITH months AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders),
have AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month,
                CASE WHEN month(o_orderdate) < 5 THEN 83 WHEN month(o_orderdate) < 9 THEN 31 ELSE 50 END AS have
         FROM orders WHERE year(o_orderdate) < 1999)
SELECT months.month, CAST(coalesce(have, 0) AS INT) AS have FROM months LEFT JOIN have USING (month)
WHERE coalesce(have, 0) < 83
""")
def months_without_secret(spark: SparkSession, folder: str) -> DataFrame:
    """Months that still need a secret or the rest of one."""
    orders = table(spark, folder, "orders")
    months = orders.select(month_of(F.col("o_orderdate")).alias("month"))
    length = (
        F.when(F.month("o_orderdate") < 5, 83).when(F.month("o_orderdate") < 9, 31).otherwise(50)
    )
    have = (
        orders.filter(F.year("o_orderdate") < 1999)
        .select(month_of(F.col("o_orderdate")).alias("month"), length.alias("length"))
        .distinct()
    )
    secrets = secrets_for(have).join(have, "month").select(
        "month", F.expr("substring(secret, 1, length)").alias("secret")
    )
    return months_needing_secret(months, secrets).select("month", "have")
