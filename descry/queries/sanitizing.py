"""Bridge sanitizers on documents derived from ``customer``, ``part`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.functions.scrub import master_key_from_cert
from descry.functions.text import last_line_value, parse_time
from descry.operators.sanitize import (
    sanitize_extra_info,
    sanitize_network_status,
    sanitize_server_descriptor,
    status_freshness,
)
from descry.operators.secrets import month_of, with_all_secrets, with_month_secret
from descry.plans.derived import (
    CRYPTO,
    as_time_text,
    bridge_extra_documents,
    bridge_server_documents,
    bridge_status_documents,
    hex_id,
    secrets_for,
    table,
    text_of,
)
from descry.queries.registry import registered
from descry.queries.scrubbing import SECRET_SQL

_NL = "chr(10)"


def _sql_text(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


_SIGNED_SQL = _sql_text("\nrouter-signature\n")

_DIGEST_SQL = "upper(sha1(unhex(sha1(signed || " + _SIGNED_SQL + "))))"


def _hash_sql(prefix: str) -> str:
    return f"sha1(unhex(sha1('{prefix}' || k)))"


_SERVER_SQL = f"""
WITH c AS (
  SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg, '2016-0' || (c_nationkey % 9 + 1) AS m,
         '10.' || c_nationkey || '.' || (c_custkey % 256) || '.9' AS ip FROM customer),
s AS (SELECT *, {SECRET_SQL} AS sec, sha1('fp' || k) AS fp FROM c),
h AS (
  SELECT *, sha256(unhex(printf('%02x%02x%02x%02x', 10, n, k % 256, 9) || fp || substr(sec, 1, 62))) AS d4,
         sha256(unhex('20010db8' || repeat('0', 20) || printf('%04x', k % 65536) || fp || substr(sec, 63, 38))) AS d6,
         sha256(unhex(printf('%04x', k % 60000 + 1) || fp || substr(sec, 101, 66))) AS dp,
         sha256(unhex(printf('%04x', n + 1) || fp || substr(sec, 101, 66))) AS da FROM s),
t AS (
  SELECT *, '10.' || CAST(CAST('0x' || substr(d4, 1, 2) AS INT) AS VARCHAR) || '.'
              || CAST(CAST('0x' || substr(d4, 3, 2) AS INT) AS VARCHAR) || '.'
              || CAST(CAST('0x' || substr(d4, 5, 2) AS INT) AS VARCHAR) AS ip_out,
         '[fd9f:2e19:3bcf::' || substr(d6, 59, 2) || ':' || substr(d6, 61, 4) || ']:'
           || ((CAST('0x' || substr(da, 1, 4) AS INT) // 4) | 49152) AS or_out,
         CAST((CAST('0x' || substr(dp, 1, 4) AS INT) // 4) | 49152 AS VARCHAR) AS port_out,
         'router c' || k || ' ' || ip || ' ' || (k % 60000 + 1) || ' 0 0' || {_NL}
           || 'or-address [2001:db8::' || printf('%x', k % 65536) || ']:' || (n + 1) || {_NL}
           || 'platform P on ' || seg || {_NL} || 'proto Link=1-4' || {_NL} || 'published ' || m
           || '-15 01:02:03' || {_NL} || 'fingerprint ' || upper(fp) || {_NL} || 'uptime ' || k || {_NL}
           || 'extra-info-digest ' || upper(sha1('ei' || k)) || {_NL} || {_sql_text(CRYPTO)}
           || 'family $' || upper(sha1('fa' || k)) || ' friend' || {_NL} || 'hidden-service-dir' || {_NL}
           || 'contact me <a@b>' || {_NL} || CASE seg WHEN 'BUILDING' THEN 'unknown-line 1' || {_NL} ELSE '' END
           || 'reject ' || ip || ':*' || {_NL} || 'reject ' || ip || '0:*' || {_NL} || 'accept *:*' AS signed
  FROM h)
SELECT k AS c_custkey, CASE seg WHEN 'BUILDING' THEN 'unrecognized line' ELSE '' END AS reject_reason,
  CASE seg WHEN 'BUILDING' THEN '' ELSE
  '@type bridge-server-descriptor 1.2' || {_NL} || 'router c' || k || ' ' || ip_out || ' ' || port_out
  || ' 0 0' || {_NL} || 'or-address ' || or_out || {_NL} || 'platform P on ' || seg || {_NL}
  || 'proto Link=1-4' || {_NL} || 'published ' || m || '-15 01:02:03' || {_NL} || 'fingerprint '
  || rtrim(regexp_replace(upper(sha1(unhex(fp))), '(.{{4}})', '\\1 ', 'g')) || {_NL} || 'uptime ' || k || {_NL}
  || 'extra-info-digest ' || upper({_hash_sql('ei')}) || {_NL} || 'family $' || upper({_hash_sql('fa')})
  || ' friend' || {_NL} || 'hidden-service-dir' || {_NL} || 'contact somebody' || {_NL}
  || 'reject ' || ip_out || ':*' || {_NL} || 'reject ' || ip || '0:*' || {_NL} || 'accept *:*' || {_NL}
  || 'router-digest ' || {_DIGEST_SQL} || {_NL} END AS sanitized FROM t
"""


@registered(_SERVER_SQL)
def sanitized_server_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    """Whole sanitized texts, addresses hashed with the month's secret."""
    docs = bridge_server_documents(spark, folder)
    published = last_line_value(F.decode("raw", "UTF-8"), "published")
    timed = docs.withColumn("__time", parse_time(published))
    months = timed.select(month_of(F.col("__time")).alias("month"))
    keyed = with_month_secret(timed, secrets_for(months), "__time")
    return (
        sanitize_server_descriptor(keyed, secret="secret")
        .select("c_custkey", "reject_reason", F.decode("sanitized", "UTF-8").alias("sanitized"))
        .fillna("")
    )


_EXTRA_SQL = f"""
WITH t AS (
  SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg, 'extra-info c' || c_custkey || ' '
    || upper(sha1('fp' || c_custkey)) || {_NL} || 'published 2016-06-15 01:02:03' || {_NL}
    || 'transport obfs 10.0.0.1:5' || {_NL} || 'transport-info secret' || {_NL} || 'bridge-ips de='
    || c_nationkey || CASE c_mktsegment WHEN 'MACHINERY' THEN {_NL} || 'surprise' ELSE '' END AS signed
  FROM customer)
SELECT k AS c_custkey, CASE seg WHEN 'MACHINERY' THEN 'unrecognized line' ELSE '' END AS reject_reason,
  CASE seg WHEN 'MACHINERY' THEN '' ELSE '@type bridge-extra-info 1.3' || {_NL} || 'extra-info c' || k
    || ' ' || upper({_hash_sql('fp')}) || {_NL} || 'published 2016-06-15 01:02:03' || {_NL} || 'transport obfs'
    || {_NL} || 'bridge-ips de=' || n || {_NL} || 'router-digest ' || {_DIGEST_SQL} || {_NL} END AS sanitized
FROM t
"""


@registered(_EXTRA_SQL)
def sanitized_extra_infos(spark: SparkSession, folder: str) -> DataFrame:
    return (
        sanitize_extra_info(bridge_extra_documents(spark, folder))
        .select("c_custkey", "reject_reason", F.decode("sanitized", "UTF-8").alias("sanitized"))
        .fillna("")
    )


def _b64_sql(hex_sql: str) -> str:
    return f"replace(to_base64(unhex({hex_sql})), '=', '')"


_STATUS_SQL = f"""
WITH e AS (
  SELECT p_partkey AS k, p_size, p_type, i, CASE i WHEN 2 THEN 'two' ELSE 'three' END AS name,
         sha1(CASE i WHEN 2 THEN 'b' ELSE 'a' END || p_partkey) AS id, p_partkey % 60000 + i AS port,
         '2016-06' AS m FROM (SELECT *, unnest([2, 3]) AS i FROM part)),
s AS (SELECT *, {SECRET_SQL} AS sec FROM e),
h AS (
  SELECT *, sha256(unhex(printf('%02x%02x%02x%02x', 10, 0, k % 256, 4) || id || substr(sec, 1, 62))) AS d4,
         sha256(unhex('20010db8' || repeat('0', 23) || '1' || id || substr(sec, 63, 38))) AS d6,
         sha256(unhex(printf('%04x', port) || id || substr(sec, 101, 66))) AS dp FROM s),
x AS (
  SELECT k, p_size, p_type, sha1(unhex(id)) AS hid,
         CAST((CAST('0x' || substr(dp, 1, 4) AS INT) // 4) | 49152 AS VARCHAR) AS port_out,
         'r ' || name || ' ' || {_b64_sql('sha1(unhex(id))')} || ' '
           || {_b64_sql("sha1(unhex(sha1('d' || k)))")} || ' 2016-06-15 01:02:03 10.'
           || CAST(CAST('0x' || substr(d4, 1, 2) AS INT) AS VARCHAR) || '.'
           || CAST(CAST('0x' || substr(d4, 3, 2) AS INT) AS VARCHAR) || '.'
           || CAST(CAST('0x' || substr(d4, 5, 2) AS INT) AS VARCHAR) || ' ' || port_out || ' 0' || {_NL}
           || 'a [fd9f:2e19:3bcf::' || substr(d6, 59, 2) || ':' || substr(d6, 61, 4) || ']:' || port_out || {_NL}
           || 's Running' || {_NL} || 'w Bandwidth=' || p_size || {_NL} AS entry FROM h)
SELECT k AS p_partkey, CASE p_size WHEN 50 THEN 'authority mismatch' ELSE '' END AS reject_reason,
  CASE p_size WHEN 50 THEN '' ELSE '@type bridge-network-status 1.2' || {_NL} || 'published '
    || CASE p_type WHEN 'ECONOMY' THEN '2016-06-15 02:00:00' ELSE '2016-06-15 01:30:00' END || {_NL}
    || 'flag-thresholds x=1' || {_NL} || 'fingerprint AAAA' || {_NL} || string_agg(entry, '' ORDER BY hid)
  END AS sanitized
FROM x GROUP BY k, p_size, p_type
"""


@registered(_STATUS_SQL)
def sanitized_network_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Whole sanitized statuses: entries sorted, the last of equal identities kept."""
    docs = bridge_status_documents(spark, folder)
    months = docs.select(F.substring("default_published", 1, 7).alias("month"))
    keyed = with_all_secrets(docs, secrets_for(months))
    return (
        sanitize_network_status(keyed, secrets="secrets")
        .select("p_partkey", "reject_reason", F.decode("sanitized", "UTF-8").alias("sanitized"))
        .fillna("")
    )


@registered("""
SELECT user_id, strftime(date_trunc('day', ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS status_time,
       coalesce(strftime(max(CASE WHEN ts <= date_trunc('day', ts) + INTERVAL 12 HOUR THEN ts END),
                '%Y-%m-%d %H:%M:%S'), '') AS newest_entry, count(*) AS n_entries,
       CASE WHEN coalesce(max(CASE WHEN ts <= date_trunc('day', ts) + INTERVAL 12 HOUR THEN ts END)
              >= date_trunc('day', ts) + INTERVAL 11 HOUR, false) THEN 'fresh' ELSE 'stale' END AS state
FROM events GROUP BY user_id, date_trunc('day', ts)
""")
def status_staleness(spark: SparkSession, folder: str) -> DataFrame:
    """Newest entry per status, and whether it is over an hour older than it."""
    noon = F.date_trunc("day", "ts") + F.expr("interval 12 hours")
    rows = table(spark, folder, "events").select("user_id", noon.alias("status_time"), "ts")
    return status_freshness(rows, ["user_id"], "status_time", "ts").select(
        "user_id",
        as_time_text("status_time").alias("status_time"),
        F.coalesce(as_time_text("newest_entry"), F.lit("")).alias("newest_entry"),
        "n_entries",
        F.when(F.col("stale"), "stale").otherwise("fresh").alias("state"),
    )


@registered("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'none'
  ELSE replace(to_base64(unhex(sha256('k' || c_custkey))), '=', '') END AS master_key FROM customer
""")
def certificate_master_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Master keys found by walking a certificate's extensions.

    Odd customers have another extension in front; one segment has the wrong
    certificate type.
    """
    k = F.col("c_custkey")
    version = F.when(F.col("c_mktsegment") == "BUILDING", "0105").otherwise("0104")
    key = F.sha2(text_of("k", k), 256)
    extension = F.concat(F.lit("00200400"), key)
    odd = k % 2 == 1
    body = F.concat(
        version,
        F.lit("00063959"),
        F.lit("01"),
        F.sha2(text_of("c", k), 256),
        F.when(odd, "02").otherwise("01"),
        F.when(odd, F.concat(F.lit("00050900"), F.substring(hex_id("x", k), 1, 10))).otherwise(""),
        extension,
        F.repeat(F.lit("ab"), F.lit(64)),
    )
    certs = table(spark, folder, "customer").select("c_custkey", F.base64(F.unhex(body)).alias("cert"))
    return certs.select(
        "c_custkey", F.coalesce(master_key_from_cert(F.col("cert")), F.lit("none")).alias("master_key")
    )


