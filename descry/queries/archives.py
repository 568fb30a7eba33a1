"""Archive paths, bundles, merging, and the file index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.functions.text import once
from descry.operators.archive import (
    assign_monthly_bundle,
    merge_sync,
    type_filter,
    with_annotation,
    with_archive_paths,
)
from descry.operators.catalog import index_file, index_tree, listable, reconcile_index, summarize_files
from descry.plans.derived import (
    EVENTS_NOW,
    ORDERS_NOW,
    SIGNATURE,
    as_time_text,
    documents_table,
    hex_id,
    made_once,
    table,
    text_of,
    utf8,
)
from descry.queries.registry import registered

_NOW = f"TIMESTAMP '{EVENTS_NOW}'"
_NL = "chr(10)"
_SIGNATURE_SQL = "'" + SIGNATURE.replace("\n", "' || chr(10) || '") + "'"


@registered("""
WITH d AS (SELECT doc_id, sha1(text) AS g FROM documents)
SELECT doc_id, 'relay-descriptors/server-descriptor/2024/02/' || g[1] || '/' || g[2] || '/' || g AS storage_path,
       'relay-descriptors/server-descriptors/2024-01-30-18-30-00-server-descriptors' AS recent_path FROM d
""")
def digest_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Archive paths by content digest."""
    d = documents_table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id",
        F.sha1("text").alias("digest"),
        F.lit("2024-02-03 04:05:06").cast("timestamp").alias("published"),
    )
    return with_archive_paths(d, "server", received=EVENTS_NOW).drop("digest", "published")


@registered("""
SELECT event_id, 'relay-descriptors/vote/' || strftime(ts, '%Y/%m/%d/%Y-%m-%d-%H-%M-%S') || '-vote-F' || user_id
         || '-' || upper(sha1('d' || event_id)) AS storage_path,
       'relay-descriptors/votes/' || strftime(ts, '%Y-%m-%d-%H-%M-%S') || '-vote-F' || user_id
         || '-' || upper(sha1('d' || event_id)) AS recent_path FROM events
""")
def time_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Archive paths by time."""
    e = table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("published"),
        text_of("F", F.col("user_id")).alias("fingerprint"),
        hex_id("d", F.col("event_id")).alias("digest"),
    )
    return with_archive_paths(e, "vote").select("event_id", "storage_path", "recent_path")


@registered("""
SELECT doc_id, sha256(CASE WHEN lang = 'en' THEN '@type x 1.0' || chr(10) || text
  ELSE '@type bandwidth-file 1.0' || chr(10) || '@source ' || source || chr(10) || text END) AS sha256
FROM documents
""")
def annotated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Default annotations for documents that carry none."""
    own = F.when(F.col("lang") == "en", "@type x 1.0\n").otherwise("")
    d = documents_table(spark, folder, "documents", "doc_id", "lang", "source", "text").select(
        "doc_id", "source", utf8(F.concat(own, F.col("text"))).alias("raw")
    )
    return with_annotation(d, "bandwidth", source="source").select(
        "doc_id", F.sha2("raw", 256).alias("sha256")
    )


@registered("""
WITH o AS (SELECT o_orderkey, o_orderdate, CASE o_orderpriority WHEN '1-URGENT' THEN 'certificate'
             WHEN '2-HIGH' THEN 'vote' WHEN '3-MEDIUM' THEN 'server' ELSE 'microdescriptor' END AS kind FROM orders)
SELECT o_orderkey, CASE kind WHEN 'certificate' THEN 'certs' ELSE
  CASE kind WHEN 'vote' THEN 'votes' WHEN 'server' THEN 'server-descriptors' ELSE 'microdescs' END
  || '-' || strftime(o_orderdate, '%Y-%m') END AS bundle
FROM o WHERE kind = 'certificate' OR (o_orderdate >= TIMESTAMP '2001-06-01' AND o_orderdate < TIMESTAMP '2001-08-01')
""")
def monthly_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the bundles a run rebuilds."""
    p = F.col("o_orderpriority")
    kind = (
        F.when(p == "1-URGENT", "certificate")
        .when(p == "2-HIGH", "vote")
        .when(p == "3-MEDIUM", "server")
        .otherwise("microdescriptor")
    )
    o = table(spark, folder, "orders").select(
        "o_orderkey", kind.alias("kind"), F.col("o_orderdate").alias("published")
    )
    return assign_monthly_bundle(o, ORDERS_NOW).select("o_orderkey", "bundle")


@registered("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')")
def wanted_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Only documents of the kinds expected."""
    return type_filter(table(spark, folder, "documents"), ["de", "fr"], "lang").select("doc_id")


@registered("""
WITH local AS (SELECT DISTINCT d.doc_id, lang, sha1(text) AS digest FROM documents d JOIN labels USING (doc_id)),
remote AS (SELECT doc_id, lang, sha1(text) AS digest FROM documents WHERE lang IN ('en', 'fr')),
fresh AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id) AS rn FROM remote r
          WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.digest = r.digest))
SELECT doc_id, digest, 'local' AS origin FROM local
UNION ALL SELECT doc_id, digest, 'remote' FROM fresh WHERE rn = 1
""")
def merged_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A second archive merged in: its rows count where ours has none."""
    texts = documents_table(spark, folder, "documents", "doc_id", "lang", "text")
    d = once(texts, digest=F.sha1("text")).drop("text")
    labelled = table(spark, folder, "labels").select("doc_id").distinct()
    local = d.join(labelled, "doc_id", "left_semi").withColumn("origin", F.lit("local"))
    remote = d.withColumn("origin", F.lit("remote"))
    return merge_sync(local, remote, ["en", "fr"], ["digest"], ["doc_id"], "lang").drop("lang")


# --- file index ----------------------------------------------------------------------------------


@registered("""
SELECT source AS path, count(*) AS n_documents, CAST(sum(n_chars) AS BIGINT) AS size,
       strftime(to_timestamp(min(doc_id) * 60) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS first_published,
       strftime(to_timestamp(max(doc_id) * 60) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_published,
       string_agg(DISTINCT lang, ',' ORDER BY lang) AS types
FROM documents GROUP BY source
""")
def file_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: documents, size, time range and types."""
    d = table(spark, folder, "documents").select(
        F.col("source").alias("path"), "lang", "n_chars", F.timestamp_seconds(F.col("doc_id") * 60).alias("t")
    )
    facts = summarize_files(d, "path", "lang", "t", F.col("n_chars"))
    return facts.select(
        "path",
        "n_documents",
        "size",
        as_time_text("first_published").alias("first_published"),
        as_time_text("last_published").alias("last_published"),
        F.array_join("types", ",").alias("types"),
    )


@registered(f"""
WITH f AS (
  SELECT o_orderkey, o_orderdate AS d, '@type server-descriptor 1.0' || {_NL} || 'router a 1 2 3 4' || {_NL}
    || 'published ' || strftime(o_orderdate, '%Y-%m-%d') || ' 01:00:00' || {_SIGNATURE_SQL}
    || '@type extra-info 1.0' || {_NL} || 'extra-info a b' || {_NL} || 'published '
    || strftime(o_orderdate, '%Y-%m-%d') || ' 02:00:00' || {_SIGNATURE_SQL}
    || CASE o_orderstatus WHEN 'P' THEN '@type microdescriptor 1.0' || {_NL} || 'onion-key' || {_NL}
                          WHEN 'F' THEN '@type unknown 1.0' || {_NL} || 'x' || {_NL} ELSE '' END AS text,
    o_orderstatus FROM orders)
SELECT 'in/' || o_orderkey AS path, length(text) AS size,
  CASE o_orderstatus WHEN 'P' THEN 'extra-info 1.0,microdescriptor 1.0,server-descriptor 1.0'
       ELSE 'extra-info 1.0,server-descriptor 1.0' END AS types,
  strftime(d, '%Y-%m-%d') || ' 01:00:00' AS first_published, strftime(d, '%Y-%m-%d') || ' 02:00:00' AS last_published,
  to_base64(unhex(sha256(text))) AS sha256
FROM f
""")
def indexed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Index facts read from the contents of files."""
    o = documents_table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_orderstatus")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    content = text_of(
        "@type server-descriptor 1.0\nrouter a 1 2 3 4\npublished ", day, " 01:00:00", SIGNATURE,
        "@type extra-info 1.0\nextra-info a b\npublished ", day, " 02:00:00", SIGNATURE,
        F.when(F.col("o_orderstatus") == "P", "@type microdescriptor 1.0\nonion-key\n")
        .when(F.col("o_orderstatus") == "F", "@type unknown 1.0\nx\n")
        .otherwise(""),
    )
    files = o.select(
        text_of("in/", F.col("o_orderkey")).alias("path"),
        utf8(content).alias("content"),
        F.length(content).cast("long").alias("length"),
        F.lit("2016-10-02 08:09:30").cast("timestamp").alias("modificationTime"),
    )
    return index_file(made_once(files, "content")).select(
        "path",
        "size",
        F.array_join("types", ",").alias("types"),
        as_time_text("first_published").alias("first_published"),
        as_time_text("last_published").alias("last_published"),
        "sha256",
    )


@registered(f"""
WITH old AS (
  SELECT 'f' || p_partkey AS path, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * p_size AS m,
         CASE WHEN p_size < 12 THEN {_NOW} - INTERVAL 1 MINUTE * (p_size * 20) END AS mark
  FROM part WHERE p_size < 40),
new AS (
  SELECT 'f' || p_partkey AS path, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (
           p_size + CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END) AS m
  FROM part WHERE p_type <> 'SMALL')
SELECT coalesce(old.path, new.path) AS path, strftime(coalesce(new.m, old.m), '%Y-%m-%d %H:%M:%S') AS last_modified,
  CASE WHEN new.path IS NOT NULL AND (old.path IS NULL OR old.m <> new.m) THEN 'index'
       WHEN new.path IS NOT NULL AND mark IS NOT NULL THEN 'unmark' WHEN new.path IS NOT NULL THEN 'keep'
       WHEN mark IS NULL THEN 'mark' WHEN mark < {_NOW} - INTERVAL 2 HOUR THEN 'delete' ELSE 'wait' END AS action
FROM old FULL JOIN new ON old.path = new.path
""")
def index_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """What to do with each file of the old index and the new listing."""
    p = table(spark, folder, "part")
    size = F.col("p_size")
    minutes = lambda n: F.make_dt_interval(mins=n)
    base, now = F.lit("2024-01-01").cast("timestamp"), F.lit(str(EVENTS_NOW)).cast("timestamp")
    path = text_of("f", F.col("p_partkey")).alias("path")
    index = p.filter(size < 40).select(
        path,
        (base + minutes(size)).alias("last_modified"),
        F.when(size < 12, now - minutes(size * 20)).alias("marked_for_deletion"),
    )
    changed = F.when(F.col("p_brand") == "Brand#1", 1).otherwise(0)
    listing = p.filter("p_type <> 'SMALL'").select(path, (base + minutes(size + changed)).alias("last_modified"))
    plan = reconcile_index(index, listing, EVENTS_NOW)
    return plan.select("path", as_time_text("last_modified").alias("last_modified"), "action")


@registered("""
SELECT doc_id FROM documents WHERE lang NOT IN ('de', 'es')
""")
def listable_files(spark: SparkSession, folder: str) -> DataFrame:
    """Hidden and temporary files are left out, by their own name."""
    name = (
        F.when(F.col("lang") == "de", text_of(".", F.col("doc_id")))
        .when(F.col("lang") == "es", text_of(F.col("doc_id"), ".tmp"))
        .otherwise(F.col("doc_id").cast("string"))
    )
    files = table(spark, folder, "documents").select("doc_id", text_of("./a/.b/", name).alias("path"))
    return listable(files).select("doc_id")


@registered("""
WITH f AS (SELECT source AS s, lang AS l, 'd' || doc_id AS n, n_chars FROM documents),
ff AS (SELECT *, row_number() OVER (PARTITION BY s, l ORDER BY n) AS rn FROM f),
sl AS (SELECT DISTINCT s, l FROM f),
sl1 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY l) AS rn FROM sl),
s1 AS (SELECT s, row_number() OVER (ORDER BY s) AS rn FROM (SELECT DISTINCT s FROM f)),
k AS (SELECT chr(1) AS u, chr(1114111) AS z)
SELECT '2' || s || u || '2' || l || u || '1' || n AS sort_key,
       CASE WHEN rn = 1 THEN '"files":[' ELSE ',' END || '{"path":"' || n || '","size":' || n_chars
         || ',"last_modified":"2024-01-02 03:04"}' AS fragment FROM ff, k
UNION ALL SELECT '2' || s || u || '2' || l || u || '1' || z, ']' FROM sl, k
UNION ALL SELECT '2' || s || u, CASE WHEN rn = 1 THEN '"directories":[' ELSE ',' END || '{"path":"' || s || '",' FROM s1, k
UNION ALL SELECT '2' || s || u || '3', '}' FROM s1, k
UNION ALL SELECT '2' || s || u || '2' || l || u, CASE WHEN rn = 1 THEN '"directories":[' ELSE ',' END || '{"path":"' || l || '",' FROM sl1, k
UNION ALL SELECT '2' || s || u || '2' || l || u || '3', '}' FROM sl, k
UNION ALL SELECT '2' || s || u || '2' || z, ']' FROM s1, k
UNION ALL SELECT '2' || z, ']' FROM k
""")
def index_json_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """The nested index as ordered fragments of one JSON document."""
    index = table(spark, folder, "documents").select(
        F.concat_ws("/", "source", "lang", text_of("d", F.col("doc_id"))).alias("path"),
        F.col("n_chars").alias("size"),
        F.lit("2024-01-02 03:04:00").cast("timestamp").alias("last_modified"),
    )
    return index_tree(index)
