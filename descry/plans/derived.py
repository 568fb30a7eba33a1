"""Operator inputs derived from the driver's tables.

The tables hold no telemetry documents, so each query first derives logs,
descriptors or edges from whole tables with plain column expressions, and then
applies the same operators the jobs use.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.functions.text import base64_unpadded, once
from descry.session import configure, spread

EVENTS_NOW = datetime(2024, 1, 30, 18, 30)
ORDERS_NOW = datetime(2001, 7, 5, 12, 0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def documents_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows become documents, on all cores."""
    return spread(table(spark, folder, name).select(*columns))


def made_once(df: DataFrame, column: str) -> DataFrame:
    """Keep a derived document from being derived again in every filter on it."""
    return once(df, **{column: F.col(column)})


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def hex_id(*parts: Column | str) -> Column:
    """A 20-byte identity in hex."""
    return F.sha1(text_of(*parts))


def b64_id(*parts: Column | str) -> Column:
    return base64_unpadded(F.unhex(hex_id(*parts)))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def as_time_text(time: Column | str) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


# --- access logs ---------------------------------------------------------------------


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One combined-log line per event; some hosts log in another time zone."""
    e = documents_table(
        spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value", "props"
    )
    user = F.col("user_id")
    method = (
        F.when(F.col("event_type") == "view", "HEAD")
        .when(F.col("event_type") == "signup", "POST")
        .otherwise("GET")
    )
    status = (
        F.when(F.col("event_type") == "purchase", "404")
        .when(F.col("event_type") == "error", "400")
        .otherwise("200")
    )
    west = user % 3 == 1
    local = F.when(west, F.col("ts") - F.expr("interval 2 hours")).otherwise(F.col("ts"))
    zone = F.when(west, "-0200").otherwise("+0000")
    size = F.when(user % 7 == 0, "-").otherwise(F.floor("value").cast("string"))
    made = e.select(
        "event_id",
        text_of("host", user % 3, ".example.org").alias("virtual_host"),
        text_of("web", user % 2).alias("physical_host"),
        text_of("logs/web", user % 2, "/log-", user).alias("path"),
        text_of(
            "10.", user % 256, ".", F.col("event_id") % 256, ".7 - - [",
            F.date_format(local, "dd/MMM/yyyy:HH:mm:ss"), " ", zone, '] "', method, " /",
            F.col("event_type"), "?k=", F.get_json_object("props", "$.k"), ' HTTP/1.1" ',
            status, " ", size, ' "-" "agent"',
        ).alias("line"),
    )
    return made_once(made, "line")


# --- addresses and secrets ---------------------------------------------------------------


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses, ports and fingerprints per event."""
    user, event = F.col("user_id"), F.col("event_id")
    return documents_table(spark, folder, "events", "event_id", "user_id", "ts").select(
        "event_id",
        F.col("ts").alias("published"),
        text_of("10.", user % 256, ".", F.floor(event / 256) % 256, ".", event % 256).alias("ipv4"),
        text_of(
            "[2001:db8::", F.lower(F.hex(user % 65536)), ":", F.lower(F.hex(event % 65536)), "]"
        ).alias("ipv6"),
        (user * 401 % 65536).cast("string").alias("port"),
        F.upper(hex_id("fp", user)).alias("fingerprint"),
    )


def month_secret(month: Column) -> Column:
    """A reproducible 83-byte secret, so that results can be checked."""
    return F.unhex(
        F.substring(F.concat(*[F.sha2(F.concat(F.lit(c), month), 256) for c in "abc"]), 1, 166)
    )


def secrets_for(months: DataFrame) -> DataFrame:
    return months.select("month").distinct().withColumn("secret", month_secret(F.col("month")))


# --- descriptors -----------------------------------------------------------------------------

SIGNATURE = "\nrouter-signature\n-----BEGIN SIGNATURE-----\nc2lnbmF0dXJl\n-----END SIGNATURE-----\n"
CRYPTO = (
    "onion-key\n-----BEGIN RSA PUBLIC KEY-----\nbm90aGluZw==\n-----END RSA PUBLIC KEY-----\n"
    "signing-key\n-----BEGIN RSA PUBLIC KEY-----\nbm90aGluZw==\n-----END RSA PUBLIC KEY-----\n"
)


def server_text(key: Column, time: Column) -> Column:
    return text_of(
        "router nick", key, " 10.1.2.3 9001 0 0\npublished ", as_time_text(time),
        "\nopt fingerprint ", F.upper(hex_id("fp", key)), "\nuptime 5\nopt extra-info-digest ",
        F.upper(hex_id("ei", key)), " AAAA", SIGNATURE,
    )


def extra_info_text(key: Column, time: Column) -> Column:
    return text_of(
        "extra-info nick", key, " ", F.upper(hex_id("fp", key)), "\npublished ",
        as_time_text(time), "\nwrite-history 5", SIGNATURE,
    )


def orders_documents(spark: SparkSession, folder: str, text_fn, annotation: str = "") -> DataFrame:
    o = documents_table(spark, folder, "orders", "o_orderkey", "o_orderdate")
    made = o.select(
        "o_orderkey", utf8(F.concat(F.lit(annotation), text_fn(F.col("o_orderkey"), F.col("o_orderdate")))).alias("raw")
    )
    return made_once(made, "raw")


def bridge_server_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A raw bridge server descriptor per customer, some with an unknown line."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    address = text_of("10.", nation, ".", k % 256, ".9")
    odd = F.when(F.col("c_mktsegment") == "BUILDING", "unknown-line 1\n").otherwise("")
    customers = documents_table(
        spark, folder, "customer", "c_custkey", "c_nationkey", "c_mktsegment"
    )
    made = customers.select(
        "c_custkey",
        utf8(
            text_of(
                "@purpose bridge\nrouter c", k, " ", address, " ", k % 60000 + 1, " 0 0\n",
                "or-address [2001:db8::", F.lower(F.hex(k % 65536)), "]:", nation + 1, "\n",
                "platform P on ", F.col("c_mktsegment"), "\nproto Link=1-4\npublished 2016-0",
                nation % 9 + 1, "-15 01:02:03\nfingerprint ", F.upper(hex_id("fp", k)),
                "\nuptime ", k, "\nextra-info-digest ", F.upper(hex_id("ei", k)), "\n", CRYPTO,
                "family $", F.upper(hex_id("fa", k)), " friend\nhidden-service-dir\ncontact me <a@b>\n",
                odd, "reject ", address, ":*\nreject ", address, "0:*\naccept *:*", SIGNATURE,
            )
        ).alias("raw"),
    )
    return made_once(made, "raw")


def bridge_extra_documents(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    made = table(spark, folder, "customer").select(
        "c_custkey",
        utf8(
            text_of(
                "extra-info c", k, " ", F.upper(hex_id("fp", k)),
                "\npublished 2016-06-15 01:02:03\ntransport obfs 10.0.0.1:5\n",
                "transport-info secret\nbridge-ips de=", F.col("c_nationkey"),
                F.when(F.col("c_mktsegment") == "MACHINERY", "\nsurprise").otherwise(""),
                SIGNATURE,
            )
        ).alias("raw"),
    )
    return made_once(made, "raw")


def bridge_status_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A raw bridge status per part: three entries, the third like the first."""
    k = F.col("p_partkey")

    def entry(name: str, identity: Column, port: Column) -> Column:
        return text_of(
            "r ", name, " ", identity, " ", b64_id("d", k), " 2016-06-15 01:02:03 10.0.",
            k % 256, ".4 ", port, " 0\na [2001:db8::1]:", port, "\na nonsense\ns Running\nw Bandwidth=",
            F.col("p_size"), "\n",
        )

    made = documents_table(spark, folder, "part", "p_partkey", "p_size", "p_type").select(
        "p_partkey",
        F.lit("AAAA").alias("authority"),
        F.lit("2016-06-15 02:00:00").alias("default_published"),
        utf8(
            F.concat(
                F.when(F.col("p_type") == "ECONOMY", F.lit("")).otherwise(
                    F.lit("published 2016-06-15 01:30:00\n")
                ),
                F.lit("flag-thresholds x=1\n"),
                F.when(F.col("p_size") == 50, F.lit("fingerprint BBBB\n")).otherwise(F.lit("")),
                entry("one", b64_id("a", k), k % 60000 + 1),
                entry("two", b64_id("b", k), k % 60000 + 2),
                entry("three", b64_id("a", k), k % 60000 + 3),
            )
        ).alias("raw"),
    )
    return made_once(made, "raw")


def status_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A status per order; orders in progress have a malformed third entry."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("__day")
    is_micro = F.col("o_orderpriority") == "1-URGENT"
    is_vote = F.col("o_orderpriority") == "5-LOW"

    def entry(i: int, identity: Column) -> Column:
        digest = F.when(is_micro, F.lit("")).otherwise(F.concat(b64_id("s", k, str(i)), F.lit(" ")))
        m_line = F.when(
            is_micro,
            text_of("m ", base64_unpadded(F.unhex(F.sha2(text_of("m", k, str(i)), 256))), "\n"),
        ).otherwise(F.when(is_vote, text_of("m 8 sha256=", F.repeat(F.lit("x"), F.lit(43)), "\n")).otherwise(""))
        bad = F.lit(i == 3) & (F.col("o_orderstatus") == "P")
        return F.concat(
            text_of("r n", str(i), " ", identity, " "),
            F.when(bad, F.lit("broken\n")).otherwise(
                F.concat(digest, text_of(day, " 00:0", str(i), ":00 10.0.0.1 9001 0\n"))
            ),
            m_line,
            F.lit("s Running\n"),
        )

    orders = documents_table(
        spark, folder, "orders",
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority",
    )
    orders = once(orders, __day=F.date_format("o_orderdate", "yyyy-MM-dd"))
    made = orders.select(
        "o_orderkey",
        utf8(
            F.concat(
                F.when(is_micro, "network-status-version 3 microdesc\n").otherwise(
                    "network-status-version 3\n"
                ),
                F.when(is_vote, "vote-status vote\n").otherwise("vote-status consensus\n"),
                text_of("valid-after ", day, " 01:00:00\n"),
                text_of("dir-source auth1 ", F.upper(hex_id("auth", c % 5)), " h 1.2.3.4 80 443\ncontact x\nvote-digest AB\n"),
                text_of("dir-source legacy ", F.upper(hex_id("legacy")), " h 1.2.3.4 80 443\ncontact x\n"),
                text_of("dir-source auth2 ", F.upper(hex_id("auth2", c % 3)), " h 1.2.3.4 80 443\ncontact x\nvote-digest CD\n"),
                text_of("fingerprint ", F.upper(hex_id("v", c)), "\n"),
                *[entry(i, b64_id("id", c, str(i))) for i in (1, 2, 3, 4)],
                F.lit("directory-footer\ndirectory-signature AB CD\n"),
            )
        ).alias("raw"),
    )
    return made_once(made, "raw")


def vote_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A vote with a key certificate per part; small parts have no entries."""
    k = F.col("p_partkey")
    made = table(spark, folder, "part").select(
        "p_partkey",
        utf8(
            F.concat(
                text_of("network-status-version 3\nvote-status vote\ndir-source a ", F.upper(hex_id("v", k)),
                        " h 1.2.3.4 80 443\n"),
                text_of("dir-key-certificate-version 3\nfingerprint ", F.upper(hex_id("v", k)),
                        "\ndir-key-published 2016-01-02 03:04:05\ndir-key-certification\n"),
                F.when(F.col("p_size") < 5, F.lit("")).otherwise(F.lit("r n a b c\n")),
                F.lit("directory-signature x\n"),
            )
        ).alias("raw"),
    )
    return made_once(made, "raw")


def bandwidth_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A bandwidth file per event, with its creation time before, after or absent."""
    t = F.col("event_type")
    created = text_of("file_created=", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "\n")
    made = table(spark, folder, "events").select(
        "event_id",
        "event_type",
        text_of("in/", F.col("event_type"), "/file", F.col("event_id")).alias("path"),
        utf8(
            F.concat(
                text_of(F.lit(1_500_000_000) + F.col("event_id"), "\nversion=1.4.0\n"),
                F.when(t == "click", created).otherwise(F.lit("")),
                F.when(t == "view", F.lit("=====\n")).otherwise(F.lit("")),
                F.when(t == "error", F.concat(F.lit("bw=5 node_id=$A\n"), created)).otherwise(F.lit("")),
                F.when(t == "signup", F.lit("file_created=nonsense\n")).otherwise(F.lit("")),
                F.lit("node_id=$B bw=7\n"),
            )
        ).alias("raw"),
    )
    return made_once(made, "raw")
