"""Deduplication, set, ordering and batching operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.functions.text import once
from descry.operators.keys import (
    accumulate,
    insert_edges,
    keep_first,
    keep_last,
    known_set,
    last_k,
    new_rows,
    overwritten,
    run_counters,
    skip_processed,
    union_sources,
)
from descry.operators.ordering import batch_keys, carry_forward, cut_at_first_bad, row_index
from descry.operators.transfers import rejected_transfer_files, validate_transfers
from descry.plans.derived import as_time_text, table, text_of
from descry.queries.registry import registered


@registered("""
SELECT doc_id, lang, source, sha1(text) AS digest FROM (
  SELECT *, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1
""")
def first_of_each_content(spark: SparkSession, folder: str) -> DataFrame:
    """Content-addressed deduplication: the first document of each digest."""
    d = table(spark, folder, "documents").select("doc_id", "lang", "source", F.sha1("text").alias("digest"))
    return keep_first(d, ["digest"], ["doc_id"])


@registered("""
SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def last_of_each_key(spark: SparkSession, folder: str) -> DataFrame:
    """A later duplicate replaces the earlier one."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    last = keep_last(e, ["user_id", "event_type"], ["ts", "event_id"])
    return last.withColumn("at", as_time_text("ts")).drop("ts")


@registered("""
SELECT event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 3
""")
def last_three(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_type", "event_id", "ts")
    return last_k(e, ["event_type"], ["ts", "event_id"]).select(
        "event_type", "event_id", as_time_text("ts").alias("at")
    )


@registered("""
SELECT source, doc_id FROM (SELECT source, doc_id FROM documents ORDER BY source DESC, doc_id DESC LIMIT 3)
""")
def last_three_overall(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("source", "doc_id")
    return last_k(d, [], ["source", "doc_id"])


@registered("""
WITH state AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase')
SELECT event_id, user_id FROM events e WHERE NOT EXISTS (
  SELECT 1 FROM state s WHERE s.user_id = e.user_id AND s.d = CAST(e.ts AS DATE))
""")
def unprocessed_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Events of users and days not processed before."""
    e = table(spark, folder, "events").withColumn("d", F.to_date("ts"))
    state = e.filter(F.col("event_type") == "purchase")
    return skip_processed(e, state, ["user_id", "d"]).select("event_id", "user_id")


@registered("""
WITH both_sources AS (
  SELECT user_id, event_type, event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS s FROM events)
SELECT user_id, event_id, s AS source_no FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS rn FROM both_sources)
WHERE rn = 1
""")
def union_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents from several sources; the earlier source wins."""
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    views, others = e.filter("event_type = 'view'"), e.filter("event_type <> 'view'")
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate((views, others))]
    return union_sources(tagged, ["user_id"], ["event_id"]).drop("event_type")


@registered("""
SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders UNION SELECT o_orderkey FROM orders
""")
def known_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct keys over several sets."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    parts = [
        c.select(F.col("c_custkey").alias("key")),
        o.select(F.col("o_custkey").alias("key")),
        o.select(F.col("o_orderkey").alias("key")),
    ]
    return known_set(parts, ["key"])


@registered("""
SELECT DISTINCT user_id, CAST(strftime(ts, '%d') AS INT) AS day FROM events
""")
def accumulated_state(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of this run added to the keys of earlier runs."""
    e = table(spark, folder, "events").select("user_id", "event_type", F.day("ts").alias("day"))
    keys = ["user_id", "day"]
    return accumulate(e.filter("event_type = 'view'"), e.filter("event_type <> 'view'"), keys)


@registered("""
WITH e AS (
  SELECT 'O-' || l_orderkey AS a, 'P-' || l_partkey AS b, l_quantity AS w, l_shipdate AS x,
         CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS s FROM lineitem)
SELECT a AS referencing, b AS referenced, w AS weight, strftime(x, '%Y-%m-%d') AS expires FROM (
  SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY s, x, w) AS rn FROM e) WHERE rn = 1
""")
def inserted_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edge set insert: weight and expiry of an existing edge stay."""
    edges = table(spark, folder, "lineitem").select(
        text_of("O-", F.col("l_orderkey")).alias("referencing"),
        text_of("P-", F.col("l_partkey")).alias("referenced"),
        F.col("l_quantity").alias("weight"),
        F.col("l_shipdate").alias("expires_at"),
        "l_returnflag",
    )
    old = edges.filter("l_returnflag = 'A'").drop("l_returnflag")
    new = edges.filter("l_returnflag <> 'A'").drop("l_returnflag")
    return insert_edges(old, new).select(
        "referencing", "referenced", "weight", F.date_format("expires_at", "yyyy-MM-dd").alias("expires")
    )


@registered("""
WITH stored AS (SELECT DISTINCT sha1(text) AS digest FROM documents JOIN labels USING (doc_id))
SELECT digest, doc_id FROM (
  SELECT sha1(text) AS digest, doc_id,
         row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS rn FROM documents) d
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.digest = d.digest)
""")
def new_only_rows(spark: SparkSession, folder: str) -> DataFrame:
    """First write wins: what the archive of labelled documents lacks."""
    texts = table(spark, folder, "documents").select("doc_id", "text")
    d = once(texts, digest=F.sha1("text")).drop("text")
    archive = d.join(table(spark, folder, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return new_rows(d, archive, ["digest"], ["doc_id"])


@registered("""
WITH both_rows AS (
  SELECT user_id, event_type, event_id, value, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS s FROM events)
SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) AS rn FROM both_rows)
WHERE rn = 1
""")
def overwritten_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Last write wins: incoming rows replace existing ones."""
    e = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    existing, incoming = e.filter("event_type = 'signup'"), e.filter("event_type <> 'signup'")
    return overwritten(existing, incoming, ["user_id"], ["event_id"]).drop("event_type")


@registered("""
SELECT CASE quality WHEN 1 THEN 'stored' ELSE 'rejected' END AS outcome,
       CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END AS type, count(*) AS n
FROM labels GROUP BY ALL
""")
def outcome_counters(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").select(
        F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("type"),
        F.when(F.col("quality") == 1, "stored").otherwise("rejected").alias("outcome"),
    )
    return run_counters(rows, "type", "outcome")


@registered("""
SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS header
FROM conversations
""")
def carried_header(spark: SparkSession, folder: str) -> DataFrame:
    """The latest header (user turn) carried to the lines after it."""
    c = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    header = F.when(F.col("role") == "user", F.col("turn"))
    return carry_forward(c, ["conv_id"], "turn", header, "header").fillna(-1, ["header"])


@registered("""
WITH bad AS (SELECT conv_id, min(turn) AS first_bad FROM conversations
             WHERE role = 'assistant' AND length(text) < 150 GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role FROM conversations c LEFT JOIN bad USING (conv_id)
WHERE first_bad IS NULL OR turn < first_bad
""")
def lines_before_first_bad(spark: SparkSession, folder: str) -> DataFrame:
    """Lines before the first malformed one; a short answer counts as malformed."""
    c = table(spark, folder, "conversations")
    bad = (F.col("role") == "assistant") & (F.length("text") < 150)
    return cut_at_first_bad(c, ["conv_id"], "turn", bad).select("conv_id", "turn", "role")


@registered("""
SELECT o_orderkey, o_orderpriority, row_number() OVER (
  PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders
""")
def global_row_index(spark: SparkSession, folder: str) -> DataFrame:
    """Rank per type in sorted output, with the sort spread over tasks."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return row_index(o, ["o_orderpriority"], ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@registered("""
WITH keys AS (
  SELECT CASE o_orderpriority WHEN '5-LOW' THEN 'micro' ELSE lower(substr(o_orderpriority, 3)) END AS type,
         sha1('o' || o_orderkey) AS key FROM orders o),
numbered AS (
  SELECT DISTINCT type, key, dense_rank() OVER (PARTITION BY type ORDER BY key) - 1 AS i FROM keys)
SELECT type, CAST(floor(i / CASE type WHEN 'micro' THEN 92 ELSE 96 END) AS BIGINT) AS batch,
       count(*) AS n_keys,
       replace(string_agg(key, '+' ORDER BY key), '+', CASE type WHEN 'micro' THEN '-' ELSE '+' END) AS keys
FROM numbered GROUP BY type, batch
""")
def batched_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted keys of the work list packed into request batches per type."""
    type_ = F.when(F.col("o_orderpriority") == "5-LOW", "micro").otherwise(
        F.lower(F.substring("o_orderpriority", 3, 100))
    )
    keys = table(spark, folder, "orders").select(
        type_.alias("type"), F.sha1(text_of("o", F.col("o_orderkey"))).alias("key")
    )
    return batch_keys(
        keys,
        "type",
        "key",
        lambda t: F.when(t == "micro", 92).otherwise(96),
        lambda t: F.when(t == "micro", "-").otherwise("+"),
    )


def _transfers(spark: SparkSession, folder: str) -> DataFrame:
    other = (F.col("l_discount") > 0.095) & (F.col("l_tax") > 0.075)
    return table(spark, folder, "lineitem").select(
        text_of("o", F.col("l_orderkey"), "-51200.tpf").alias("path"),
        text_of("o", F.col("l_orderkey")).alias("file_source"),
        F.lit(51200).alias("file_size"),
        F.lit("2016-10-02").cast("date").alias("file_date"),
        F.when(other, F.lit("other")).otherwise(text_of("o", F.col("l_orderkey"))).alias("source"),
        F.when(F.col("l_quantity") == 50, 1).otherwise(51200).alias("filesize"),
        F.lit("2016-10-02 05:00:00").cast("timestamp").alias("start"),
        "l_orderkey",
        "l_linenumber",
    )


_TRANSFER_SQL = """
WITH t AS (SELECT l_orderkey, l_linenumber,
                  (l_discount > 0.095 AND l_tax > 0.075) OR l_quantity = 50 AS bad FROM lineitem)
"""


@registered(
    _TRANSFER_SQL
    + """SELECT l_orderkey, l_linenumber FROM t WHERE l_orderkey NOT IN
         (SELECT l_orderkey FROM t WHERE bad)"""
)
def validated_transfers(spark: SparkSession, folder: str) -> DataFrame:
    """One disagreeing row rejects its whole file."""
    return validate_transfers(_transfers(spark, folder)).select("l_orderkey", "l_linenumber")


@registered(
    _TRANSFER_SQL
    + """SELECT 'o' || l_orderkey || '-51200.tpf' AS path, count(*) AS n_bad
         FROM t WHERE bad GROUP BY l_orderkey"""
)
def rejected_transfers(spark: SparkSession, folder: str) -> DataFrame:
    return rejected_transfer_files(_transfers(spark, folder))
