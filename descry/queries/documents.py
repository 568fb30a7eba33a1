"""Splitting, classifying and parsing documents derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.functions.digests import descriptor_digest
from descry.operators.documents import (
    classify_descriptor,
    descriptor_time,
    expected_votes,
    extract_certificates,
    microdesc_with_valid_after,
    parse_bandwidth_header,
    parse_extra_info,
    parse_microdescriptor,
    parse_server_descriptor,
    parse_status,
    split_descriptors,
    split_lines,
    status_dir_sources,
    status_entries,
)
from descry.plans.derived import (
    SIGNATURE,
    as_time_text,
    bandwidth_documents,
    documents_table,
    extra_info_text,
    hex_id,
    made_once,
    orders_documents,
    server_text,
    status_documents,
    table,
    text_of,
    utf8,
    vote_documents,
)
from descry.queries.registry import registered
from descry.sources.listings import (
    parse_exit_lists,
    parse_pool_assignments,
    parse_proxy_stats,
    parse_tpf,
)

_SIGNATURE_SQL = "'" + SIGNATURE.replace("\n", "' || chr(10) || '") + "'"
_SIGNED_SQL = "chr(10) || 'router-signature' || chr(10)"
_NL = "chr(10)"


@registered("""
WITH plain AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(
    text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS lines FROM documents)
SELECT doc_id, CAST(i - 1 AS INT) AS pos, lines[i] AS line
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM plain)
""")
def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of whole documents with their position."""
    return split_lines(documents_table(spark, folder, "documents", "doc_id", "text"))


@registered("""
SELECT doc_id, CASE lang WHEN 'en' THEN 'server' WHEN 'fr' THEN 'extra-info' WHEN 'de' THEN 'microdescriptor'
  ELSE CASE doc_id % 6 WHEN 0 THEN 'consensus' WHEN 1 THEN 'consensus-microdesc' WHEN 2 THEN 'vote'
                       WHEN 3 THEN 'bandwidth' WHEN 4 THEN 'bridge-status' ELSE 'unknown' END END AS kind
FROM documents
""")
def classified_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Kind by the first line that is no annotation, over whole texts."""
    n = F.col("doc_id") % 6
    head = (
        F.when(F.col("lang") == "en", "@purpose bridge\nrouter a b\n")
        .when(F.col("lang") == "fr", "extra-info a b\n")
        .when(F.col("lang") == "de", "@type microdescriptor 1.0\n@source x\nonion-key\n")
        .when(n == 0, "network-status-version 3\nvote-status consensus\n")
        .when(n == 1, "network-status-version 3 microdesc\n")
        .when(n == 2, "network-status-version 3\nvote-status vote\n")
        .when(n == 3, "1234567890\n")
        .when(n == 4, "flag-thresholds a=1\n")
        .otherwise("12345678901\n")
    )
    docs = documents_table(spark, folder, "documents", "doc_id", "lang", "text").select(
        "doc_id", utf8(F.concat(head, F.col("text"))).alias("raw")
    )
    return classify_descriptor(made_once(docs, "raw")).drop("raw")


@registered(f"""
WITH docs AS (
  SELECT o_orderkey, 0 AS pos, 'router a' || o_orderkey || {_NL} || 'x' || {_SIGNATURE_SQL} AS raw FROM orders
  UNION ALL
  SELECT o_orderkey, 1, 'router b' || o_custkey || {_NL} || 'y' || {_SIGNATURE_SQL} FROM orders
  WHERE o_orderstatus <> 'F')
SELECT o_orderkey, CAST(pos AS INT) AS pos, 'server' AS kind, sha1(raw) AS digest FROM docs
""")
def split_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of concatenated files; a truncated tail is dropped."""
    second = text_of("router b", F.col("o_custkey"), "\ny", SIGNATURE)
    tail = F.when(F.col("o_orderstatus") == "F", F.rtrim(F.regexp_replace(second, "-----END.*\n", "")))
    orders = documents_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    files = orders.select(
        "o_orderkey",
        utf8(
            F.concat(
                text_of("@type server-descriptor 1.0\nrouter a", F.col("o_orderkey"), "\nx", SIGNATURE),
                F.coalesce(tail, second),
            )
        ).alias("raw"),
    )
    return split_descriptors(made_once(files, "raw"), "server").select(
        "o_orderkey", "pos", "kind", F.sha1("raw").alias("digest")
    )


@registered(f"""
SELECT doc_id, sha1('router x' || {_NL} || text || {_SIGNED_SQL}) AS server_digest,
       sha1('extra-info x' || {_NL} || text || {_SIGNED_SQL}) AS extra_digest,
       sha256(text) AS micro_digest, sha256('1234567890' || {_NL} || text) AS bandwidth_digest
FROM documents
""")
def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests that name documents, over whole texts."""
    wrapped = lambda head: utf8(text_of(head, F.col("text"), SIGNATURE))
    docs = documents_table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id",
        wrapped("@purpose bridge\nrouter x\n").alias("server"),
        wrapped("@type extra-info 1.0\nextra-info x\n").alias("extra"),
        utf8(F.col("text")).alias("micro"),
        utf8(text_of("@type bandwidth-file 1.0\n1234567890\n", F.col("text"))).alias("bandwidth"),
    )
    return docs.select(
        "doc_id",
        descriptor_digest(F.col("server"), "server").alias("server_digest"),
        descriptor_digest(F.col("extra"), "extra-info").alias("extra_digest"),
        descriptor_digest(F.col("micro"), "microdescriptor").alias("micro_digest"),
        descriptor_digest(F.col("bandwidth"), "bandwidth").alias("bandwidth_digest"),
    )


_STATUS_SQL = """
WITH o AS (
  SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'consensus-microdesc' WHEN '5-LOW' THEN 'vote'
            ELSE 'consensus' END AS kind FROM orders),
entry AS (
  SELECT o_orderkey, kind, o_orderdate, i, 'id' || o_custkey || i AS id, 's' || o_orderkey || i AS s,
         'm' || o_orderkey || i AS m
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM o) WHERE NOT (o_orderstatus = 'P' AND i >= 3))
"""


@registered(
    _STATUS_SQL
    + """SELECT o_orderkey, kind, sha1(id) AS relay_identity,
           CASE WHEN kind = 'consensus-microdesc' THEN '' ELSE sha1(s) END AS server_digest,
           strftime(o_orderdate, '%Y-%m-%d') || ' 00:0' || i || ':00' AS published,
           CASE WHEN kind = 'consensus-microdesc' THEN sha256(m) ELSE '' END AS micro_digest
         FROM entry"""
)
def parsed_status_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of statuses up to the first malformed line."""
    statuses = parse_status(status_documents(spark, folder))
    entries = status_entries(statuses, ["o_orderkey", "kind"]).drop("n_entries")
    return entries.withColumn("published", as_time_text("published")).fillna("")


@registered(
    _STATUS_SQL
    + """SELECT o_orderkey, kind, strftime(o_orderdate, '%Y-%m-%d') || ' 01:00:00' AS valid_after,
           upper(sha1('v' || o_custkey)) AS fingerprint, upper(sha1('auth2' || (o_custkey % 3))) AS dir_source,
           CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 4 END AS n_entries FROM o"""
)
def parsed_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Header fields of statuses."""
    return parse_status(status_documents(spark, folder)).select(
        "o_orderkey",
        "kind",
        as_time_text("valid_after").alias("valid_after"),
        "fingerprint",
        "dir_source",
        F.size("entries").alias("n_entries"),
    )


@registered(
    _STATUS_SQL
    + """, ids AS (
           SELECT o_orderdate, 'auth' || (o_custkey % 5) AS identity FROM o WHERE kind = 'consensus'
           UNION ALL SELECT o_orderdate, 'auth2' || (o_custkey % 3) FROM o WHERE kind = 'consensus')
         SELECT strftime(o_orderdate, '%Y-%m-%d') || ' 01:00:00' AS valid_after,
                count(DISTINCT sha1(identity)) AS expected_votes FROM ids GROUP BY o_orderdate"""
)
def expected_vote_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Authorities with a vote digest per consensus; legacy sources do not count."""
    sources = status_dir_sources(parse_status(status_documents(spark, folder)))
    return expected_votes(sources).withColumn("valid_after", as_time_text("valid_after"))


@registered(f"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS published,
       sha1('fp' || o_orderkey) AS fingerprint, sha1('ei' || o_orderkey) AS extra_info_digest,
       sha1('router nick' || o_orderkey || ' 10.1.2.3 9001 0 0' || {_NL} || 'published '
         || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || {_NL} || 'opt fingerprint '
         || upper(sha1('fp' || o_orderkey)) || {_NL} || 'uptime 5' || {_NL} || 'opt extra-info-digest '
         || upper(sha1('ei' || o_orderkey)) || ' AAAA' || {_SIGNED_SQL}) AS digest FROM orders
""")
def parsed_server_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    docs = orders_documents(spark, folder, server_text, "@type server-descriptor 1.0\n")
    return (
        parse_server_descriptor(docs).withColumn("published", as_time_text("published")).drop("raw")
    )


@registered(f"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS published,
       sha1('fp' || o_orderkey) AS fingerprint,
       sha1('extra-info nick' || o_orderkey || ' ' || upper(sha1('fp' || o_orderkey)) || {_NL}
         || 'published ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || {_NL} || 'write-history 5'
         || {_SIGNED_SQL}) AS digest FROM orders
""")
def parsed_extra_infos(spark: SparkSession, folder: str) -> DataFrame:
    docs = orders_documents(spark, folder, extra_info_text, "@type extra-info 1.0\n")
    return parse_extra_info(docs).withColumn("published", as_time_text("published")).drop("raw")


@registered(f"""
SELECT event_id, event_type AS source,
       CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(to_timestamp(1500000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')
       END AS created,
       upper(sha256((1500000000 + event_id) || {_NL} || 'version=1.4.0' || {_NL}
         || CASE event_type WHEN 'click' THEN 'file_created=' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || {_NL}
              WHEN 'view' THEN '=====' || {_NL}
              WHEN 'error' THEN 'bw=5 node_id=$A' || {_NL} || 'file_created='
                                || strftime(ts, '%Y-%m-%dT%H:%M:%S') || {_NL}
              WHEN 'signup' THEN 'file_created=nonsense' || {_NL} ELSE '' END
         || 'node_id=$B bw=7' || {_NL})) AS digest FROM events
""")
def parsed_bandwidth_headers(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_bandwidth_header(bandwidth_documents(spark, folder), path="path")
    return parsed.select("event_id", "source", as_time_text("created").alias("created"), "digest")


@registered(f"""
SELECT p_partkey, upper(sha1('v' || p_partkey)) AS fingerprint, '2016-01-02 03:04:05' AS key_published,
       'dir-key-certificate-version 3' || {_NL} || 'fingerprint ' || upper(sha1('v' || p_partkey)) || {_NL}
         || 'dir-key-published 2016-01-02 03:04:05' || {_NL} || 'dir-key-certification' || {_NL} AS certificate
FROM part WHERE p_size >= 5
""")
def extracted_certificates(spark: SparkSession, folder: str) -> DataFrame:
    """Key certificates in votes; none without an entry line after it."""
    return extract_certificates(vote_documents(spark, folder)).select(
        "p_partkey",
        "fingerprint",
        as_time_text("key_published").alias("key_published"),
        F.decode("raw", "UTF-8").alias("certificate"),
    )


@registered("""
SELECT DISTINCT sha256('m' || p_partkey) AS sha256_hex, p_partkey,
       strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS valid_after
FROM part JOIN lineitem ON l_partkey = p_partkey
""")
def microdesc_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """One row per microdescriptor and month of a status referring to it."""
    micro = parse_microdescriptor(
        table(spark, folder, "part").select(
            "p_partkey", utf8(text_of("m", F.col("p_partkey"))).alias("raw")
        )
    ).select("p_partkey", "sha256_hex")
    entries = table(spark, folder, "lineitem").select(
        F.sha2(text_of("m", F.col("l_partkey")), 256).alias("micro_digest"),
        F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd").alias("valid_after"),
    )
    return microdesc_with_valid_after(micro, entries)


@registered("""
SELECT event_id, event_type AS kind, strftime(CASE event_type
  WHEN 'view' THEN to_timestamp(1500000000 + event_id) AT TIME ZONE 'UTC'
  ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS published
FROM events WHERE event_type <> 'signup'
""")
def document_times(spark: SparkSession, folder: str) -> DataFrame:
    """One publication time per document; microdescriptors (signups) have none."""
    t, time = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = (
        F.when(t == "click", "consensus")
        .when(t == "view", "transfer")
        .when(t == "error", "exit-list")
        .when(t == "purchase", "proxy-stats")
        .otherwise("microdescriptor")
    )
    text = (
        F.when(t == "click", text_of("network-status-version 3\nvalid-after ", time, "\npublished x\n"))
        .when(t == "view", text_of("SOURCE=a START=", F.lit(1_500_000_000) + F.col("event_id"), ".25 X=1"))
        .when(t == "error", text_of("Downloaded ", time, "\nExitNode A\nPublished 2000-01-01 00:00:00\n"))
        .when(t == "purchase", text_of("snowflake-stats-end ", time, " (86400 s)\nx 1\n"))
        .otherwise("onion-key\n")
    )
    docs = table(spark, folder, "events").select(
        "event_id", "event_type", kind.alias("kind"), utf8(text).alias("raw")
    )
    return (
        descriptor_time(docs)
        .filter(F.col("published").isNotNull())
        .select("event_id", F.col("event_type").alias("kind"), as_time_text("published").alias("published"))
    )


# --- lists, timings and statistics ------------------------------------------------------


@registered("""
WITH rows AS (SELECT c_custkey, unnest([1, 2]) AS i, c_nationkey, c_mktsegment FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS path, upper(sha1('n' || c_custkey || i)) AS node,
       '2016-09-20 13:02:00' AS downloaded, '2016-09-19 01:02:03' AS published,
       '2016-09-19 02:00:00' AS last_status, '10.0.' || c_nationkey || '.' || i AS address,
       '2016-09-19 03:0' || i || ':00' AS scan_ts
FROM rows WHERE c_mktsegment <> 'BUILDING'
""")
def exit_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Exit addresses of lists; texts that are more than one list are rejected."""
    k = F.col("c_custkey")

    def node(i: int) -> F.Column:
        return text_of(
            "ExitNode ", F.upper(hex_id("n", k, str(i))), "\nPublished 2016-09-19 01:02:03\n",
            "LastStatus 2016-09-19 02:00:00\nExitAddress 10.0.", F.col("c_nationkey"), f".{i} ",
            f"2016-09-19 03:0{i}:00\n",
        )

    head = "@type tordnsel 1.0\nDownloaded 2016-09-20 13:02:00\n"
    foreign = F.when(F.col("c_mktsegment") == "BUILDING", "other 1\n").otherwise("")
    texts = table(spark, folder, "customer").select(
        k.cast("string").alias("path"), F.concat(F.lit(head), node(1), node(2), foreign).alias("text")
    )
    times = ("downloaded", "published", "last_status", "scan_ts")
    parsed = parse_exit_lists(texts)
    return parsed.select(
        "path", "node", "address", *[as_time_text(t).alias(t) for t in times]
    )


@registered("""
WITH lines AS (
  SELECT o_orderkey, '2016-04-09 00:29:37' AS published, sha1('a' || o_custkey) AS fingerprint, 'email last=1' AS details
  FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT o_orderkey, '2016-04-09 00:29:37', sha1('b' || o_custkey), 'https ring=2' FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT o_orderkey, '2016-04-10 00:29:37', sha1('c' || o_custkey), 'moat' FROM orders WHERE o_orderstatus = 'O')
SELECT CAST(o_orderkey AS VARCHAR) AS path, published, fingerprint, details FROM lines
""")
def pool_assignment_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Assignments per group; a malformed line stops its file, later duplicates win."""
    c = F.col("o_custkey")
    first = text_of(
        "bridge-pool-assignment 2016-04-09 00:29:37\n", hex_id("z", c), " discarded\n",
        "bridge-pool-assignment 2016-04-09 00:29:37\n", hex_id("a", c), " email first\n",
        hex_id("b", c), " https ring=2\n", hex_id("a", c), " email last=1\n",
    )
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("no header\n"), first))
        .when(F.col("o_orderstatus") == "P", F.concat(first, F.lit("short line\n"), first))
        .otherwise(
            F.concat(first, text_of("bridge-pool-assignment 2016-04-10 00:29:37\n", hex_id("c", c), " moat"))
        )
    )
    orders = documents_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    texts = orders.select(
        F.col("o_orderkey").cast("string").alias("path"), text.alias("text")
    )
    return parse_pool_assignments(made_once(texts, "text")).withColumn("published", as_time_text("published"))


@registered("""
SELECT event_id, event_type AS source, CAST(user_id AS INT) AS filesize,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS start, 's' || user_id AS file_source, 51200 AS file_size
FROM events
""")
def timing_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of timing rows, and what their file name says."""
    rows = table(spark, folder, "events").select(
        text_of("in/s", F.col("user_id"), "-51200-2016-10-02.tpf").alias("path"),
        text_of(
            "ID=", F.col("event_id"), " SOURCE=", F.col("event_type"), " FILESIZE=", F.col("user_id"),
            " START=", F.unix_timestamp(F.col("ts").cast("timestamp")), ".50 DIDTIMEOUT=0",
        ).alias("line"),
    )
    return parse_tpf(rows).select(
        F.col("kv")["ID"].cast("long").alias("event_id"),
        "source",
        "filesize",
        as_time_text("start").alias("start"),
        "file_source",
        "file_size",
    )


@registered("""
SELECT c_custkey, CAST(i AS INT) AS pos, '2020-01-0' || (i + 1) || ' 00:00:00' AS stats_end,
       CAST(length('snowflake-stats-end 2020-01-01 00:00:00 (86400 s)' || chr(10) || 'snowflake-ips US=' || c_nationkey || chr(10)) AS INT) AS n
FROM (SELECT c_custkey, c_nationkey, unnest([0, 1, 2]) AS i FROM customer)
""")
def statistics_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics documents of texts holding many, keyed by their end."""
    part = lambda i: text_of(
        f"@type snowflake-stats 1.0\nsnowflake-stats-end 2020-01-0{i} 00:00:00 (86400 s)\n",
        "snowflake-ips US=", F.col("c_nationkey"), "\n",
    )
    texts = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("path"), F.concat(part(1), part(2), part(3)).alias("text")
    )
    # position 0 is what precedes the first document
    return parse_proxy_stats(texts).select(
        F.col("path").cast("long").alias("c_custkey"),
        (F.col("pos") - 1).alias("pos"),
        as_time_text("stats_end").alias("stats_end"),
        F.length("raw").alias("n"),
    )
