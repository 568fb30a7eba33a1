"""Pseudonyms against fixed expected values and a plain Python computation."""

import base64
import hashlib
import ipaddress

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import (
    ADDRESS,
    ADDRESS_6,
    CERTIFICATE,
    FINGERPRINT,
    HASHED_FINGERPRINT,
    HASHED_MASTER_KEY,
    MASTER_KEY,
    OTHER_ADDRESS,
    OTHER_ADDRESS_6,
    OTHER_PORT,
    PORT,
    PORT_6,
    SECRET_HEX,
    grouped,
    scrubbed_port,
)

from descry.functions import scrub
from descry.functions.text import unbase64_unpadded

SECRET = bytes.fromhex(SECRET_HEX)


def frame(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return df.withColumn("fp", F.lit(FINGERPRINT)).withColumn(
        "secret", F.unhex(F.lit(SECRET_HEX))
    )


def run(spark, function, values, keyed=True):
    args = [F.col("v"), F.col("fp")] + ([F.col("secret")] if keyed else [])
    rows = frame(spark, values).select("i", function(*args).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_fixed_addresses(spark):
    assert run(spark, scrub.scrub_ipv4, [ADDRESS]) == [OTHER_ADDRESS]
    assert run(spark, scrub.scrub_tcp_port, [PORT, "25", "0"]) == [
        OTHER_PORT,
        scrubbed_port(25),
        "0",
    ]
    assert run(spark, scrub.scrub_or_address, [f"{ADDRESS_6}:{PORT_6}"]) == [OTHER_ADDRESS_6]


def test_without_secret(spark):
    assert run(spark, scrub.scrub_or_address, ["1.2.3.4:9", "[::1]:0", "nonsense"], False) == [
        "127.0.0.1:1",
        "[fd9f:2e19:3bcf::]:0",
        None,
    ]


def test_malformed_addresses_give_null(spark):
    assert run(spark, scrub.scrub_ipv4, ["1.2.3", "1.2.3.256", "a.b.c.d", ""]) == [None] * 4
    bad = ["[12345::]", "[1::2::3]", "[g::1]", "[1:2:3]", "[1:2:3:4:5:6:7:8:9]", "[::1.2.3]"]
    assert run(spark, scrub.scrub_ipv6, bad) == [None] * len(bad)
    assert run(spark, scrub.scrub_tcp_port, ["x", ""]) == [None, None]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(0, 2**128 - 1), min_size=50, max_size=50))
def test_ipv6_expansion_agrees_with_python(spark, numbers):
    addresses = [ipaddress.IPv6Address(n) for n in numbers]
    texts = [f"[{a}]" for a in addresses] + [f"[{a.exploded}]" for a in addresses]
    rows = frame(spark, texts).select("i", scrub.ipv6_hex(F.col("v")).alias("o")).orderBy("i")
    assert [int(r.o, 16) for r in rows.collect()] == numbers + numbers


def test_ipv4_agrees_with_python(spark):
    texts = [f"{a}.{b}.0.255" for a in (0, 9, 77, 255) for b in (1, 200)]
    expected = []
    for t in texts:
        data = ipaddress.IPv4Address(t).packed + bytes.fromhex(FINGERPRINT) + SECRET[:31]
        expected.append("10." + ".".join(str(x) for x in hashlib.sha256(data).digest()[:3]))
    assert run(spark, scrub.scrub_ipv4, texts) == expected


def test_fingerprints(spark):
    row = frame(spark, [FINGERPRINT, "zz", "123"]).select(
        scrub.grouped_by_four(scrub.hash_fingerprint(F.col("v"))).alias("o")
    )
    assert [r.o for r in row.collect()] == [
        grouped(HASHED_FINGERPRINT),
        None,
        None,
    ]


def test_master_key(spark):
    good = "".join(CERTIFICATE)
    raw = bytearray(base64.b64decode(good))
    variants = [good]
    for offset, value in ((0, 2), (1, 5), (6, 2), (39, 0), (42, 5)):
        changed = bytearray(raw)
        changed[offset] = value
        variants.append(base64.b64encode(changed).decode())
    variants += [base64.b64encode(raw[:60]).decode(), "", "AQ=="]
    rows = frame(spark, variants).select(
        "i", scrub.master_key_from_cert(F.col("v")).alias("k"),
        scrub.hash_base64_sha256(scrub.master_key_from_cert(F.col("v"))).alias("h"),
    ).orderBy("i").collect()
    assert (rows[0].k, rows[0].h) == (MASTER_KEY, HASHED_MASTER_KEY)
    assert [r.k for r in rows[1:]] == [None] * (len(variants) - 1)


def test_base64_of_any_length(spark):
    values = ["", "A", "AA", "AAA", "AAAA", "AAAAA", "A-_=\nB"]
    rows = frame(spark, values).select("i", unbase64_unpadded(F.col("v")).alias("o")).orderBy("i")
    lengths = [len(bytes(r.o)) for r in rows.collect()]
    assert lengths == [0, 0, 1, 2, 3, 3, 3]
