"""Sanitizers: whole expected documents, and one changed line at a time."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F
from samples import (
    ADDRESS,
    ADDRESS_6,
    AUTHORITY,
    CERTIFICATE,
    ENTRY,
    EXTRA_DIGEST,
    EXTRA_DIGEST_256,
    EXTRA_INFO_LINES,
    FINGERPRINT,
    HASHED_FINGERPRINT,
    HASHED_MASTER_KEY,
    HASHED_R,
    IDENTITY,
    MASTER_KEY,
    MONTH,
    NTOR_KEY,
    OTHER_ADDRESS,
    OTHER_ADDRESS_6,
    OTHER_PORT,
    PORT,
    PORT_6,
    PUBLISHED,
    SECRET_HEX,
    SERVER_LINES,
    STATUS_LINES,
    double_sha1,
    double_sha256,
    edited,
    grouped,
    text,
    unpadded,
)

from descry.operators.sanitize import (
    sanitize_extra_info,
    sanitize_network_status,
    sanitize_server_descriptor,
)


def server(spark, documents, keyed=False):
    rows = [(i, bytearray(d.encode("latin-1"))) for i, d in enumerate(documents)]
    df = spark.createDataFrame(rows, "i int, raw binary")
    if keyed:
        df = df.withColumn("secret", F.unhex(F.lit(SECRET_HEX)))
    return sanitize_server_descriptor(df, secret="secret" if keyed else None).orderBy("i").collect()


HASHED_EXTRA = hashlib.sha1(EXTRA_DIGEST).hexdigest().upper()
HASHED_EXTRA_256 = unpadded(hashlib.sha256(EXTRA_DIGEST_256).digest())


def lines(row):
    return bytes(row.sanitized).decode("latin-1").splitlines() if row.sanitized else None


def test_server_descriptor(spark):
    document = text(SERVER_LINES)
    (row,) = server(spark, [document])
    assert lines(row) == [
        "@type bridge-server-descriptor 1.2",
        "router Heron 127.0.0.1 1 0 0",
        "master-key-ed25519 " + HASHED_MASTER_KEY,
        "bandwidth 5242880 10485760 3145728",
        "platform Tor 0.4.2.1 on FreeBSD",
        "published " + PUBLISHED,
        "fingerprint " + grouped(HASHED_FINGERPRINT),
        "uptime 86417",
        f"extra-info-digest {HASHED_EXTRA} {HASHED_EXTRA_256}",
        "caches-extra-info",
        "ntor-onion-key " + NTOR_KEY,
        "contact somebody",
        "reject 127.0.0.1:*",
        "reject *:*",
        "router-digest-sha256 " + double_sha256(document, "router "),
        "router-digest " + double_sha1(document, "router ").upper(),
    ]
    assert row.published == PUBLISHED
    assert row.digest == double_sha1(document, "router ")


def test_server_descriptor_keyed(spark):
    document = text(edited(SERVER_LINES, "platform ", f"or-address {ADDRESS_6}:{PORT_6}"))
    (row,) = server(spark, [document], keyed=True)
    assert f"router Heron {OTHER_ADDRESS} {OTHER_PORT} 0 0" in lines(row)
    assert f"or-address {OTHER_ADDRESS_6}" in lines(row)
    assert f"reject {OTHER_ADDRESS}:*" in lines(row)


CHANGES = {
    "short router line": ("router Heron", ["router Heron"]),
    "no router line": ("router Heron", []),
    "long router line": ("router Heron", ["router Heron 1.2.3.4 1 0 0 0"]),
    "odd fingerprint": ("fingerprint", ["fingerprint 4"]),
    "no hex fingerprint": ("fingerprint", ["fingerprint " + "z" * 40]),
    "no fingerprint": ("fingerprint", []),
    "no published": ("published", []),
    "unknown line": ("uptime", ["uptime 1", "unknown thing"]),
    "long extra-info-digest": ("extra-info-digest", ["extra-info-digest 5A5A AA BB"]),
    "bad extra-info-digest": ("extra-info-digest", ["extra-info-digest zz"]),
    "bad base64 digest": ("extra-info-digest", ["extra-info-digest 5A5A A%A"]),
    "other master key": ("master-key-ed25519", ["master-key-ed25519 AAAA"]),
    "unreadable certificate": (CERTIFICATE[0], ["AAAA"]),
    "bad family member": ("uptime", ["family $zz"]),
    "bad or-address": ("uptime", ["or-address nonsense"]),
    "source line": ("uptime", ["@source " + ADDRESS]),
    "no signature": ("router-signature", []),
}


def test_server_descriptor_rejects(spark):
    documents = [text(edited(SERVER_LINES, start, *new)) for start, new in CHANGES.values()]
    rows = server(spark, documents)
    accepted = [name for name, row in zip(CHANGES, rows) if row.sanitized is not None]
    assert accepted == []
    assert all(row.reject_reason for row in rows)


ACCEPTED = {
    "proto": ("platform", ["proto Desc=1-2 Link=4-5"], "proto Desc=1-2 Link=4-5"),
    "opt fingerprint": (
        "fingerprint",
        ["opt fingerprint " + grouped(FINGERPRINT)],
        "opt fingerprint " + grouped(HASHED_FINGERPRINT),
    ),
    "opt digest": (
        "extra-info-digest",
        ["opt extra-info-digest " + EXTRA_DIGEST.hex().upper()],
        "opt extra-info-digest " + HASHED_EXTRA,
    ),
    "family": (
        "uptime",
        [f"family ${FINGERPRINT} egret"],
        f"family ${HASHED_FINGERPRINT} egret",
    ),
    "longer own address": ("reject *", [f"reject {ADDRESS}9:*"], f"reject {ADDRESS}9:*"),
    "purpose": ("uptime", ["@purpose bridge"], "caches-extra-info"),
}


def test_server_descriptor_accepts(spark):
    documents = [text(edited(SERVER_LINES, start, *new)) for start, new, _ in ACCEPTED.values()]
    for (name, (_, _, expected)), row in zip(ACCEPTED.items(), server(spark, documents)):
        assert row.sanitized is not None, name
        assert expected in lines(row), name


def test_nothing_sensitive_survives(spark):
    (row,) = server(spark, [text(SERVER_LINES)], keyed=True)
    out = bytes(row.sanitized).decode()
    hidden = (ADDRESS, FINGERPRINT[:4] + " ", "keeper", "RSA PUBLIC", PORT, MASTER_KEY[:8])
    for secret in hidden:
        assert secret not in out


def test_windows_lines_and_missing_secret(spark):
    (row,) = server(spark, [text(SERVER_LINES).replace("\n", "\r\n")])
    assert "contact somebody" in lines(row)
    df = spark.createDataFrame([(1, bytearray(text(SERVER_LINES).encode()))], "i int, raw binary")
    df = df.withColumn("secret", F.lit(None).cast("binary"))
    (row,) = sanitize_server_descriptor(df, secret="secret").collect()
    assert row.sanitized is None and row.reject_reason


def extra(spark, documents):
    rows = [(i, bytearray(d.encode())) for i, d in enumerate(documents)]
    df = spark.createDataFrame(rows, "i int, raw binary")
    return sanitize_extra_info(df).orderBy("i").collect()


def test_extra_info(spark):
    document = text(EXTRA_INFO_LINES)
    (row,) = extra(spark, [document])
    assert lines(row) == [
        "@type bridge-extra-info 1.3",
        "extra-info Heron " + HASHED_FINGERPRINT,
        "master-key-ed25519 " + HASHED_MASTER_KEY,
        "published " + PUBLISHED,
        "read-history 2019-11-05 03:00:00 (86400 s) 7340032,1048576",
        "transport obfs4",
        "bridge-ips nz=16,is=8",
        "router-digest-sha256 " + double_sha256(document, "extra-info "),
        "router-digest " + double_sha1(document, "extra-info ").upper(),
    ]


def test_extra_info_rejects(spark):
    changes = [
        ("extra-info", ["extra-info Heron"]),
        ("extra-info", ["extra-info Heron zz"]),
        ("transport obfs4", ["transport obfs4"]),
        ("bridge-ips", ["unknown"]),
        ("bridge-ips", ["master-key-ed25519 AAAA"]),
        (CERTIFICATE[0], ["AAAA"]),
        ("published", []),
    ]
    rows = extra(spark, [text(edited(EXTRA_INFO_LINES, s, *new)) for s, new in changes])
    assert [r.sanitized for r in rows] == [None] * len(changes)


def status(spark, documents, keyed=False):
    rows = [(i, bytearray(d.encode())) for i, d in enumerate(documents)]
    df = spark.createDataFrame(rows, "i int, raw binary")
    df = df.withColumn("authority", F.lit(AUTHORITY)).withColumn(
        "default_published", F.lit("2019-11-05 12:13:14")
    )
    if keyed:
        df = df.withColumn("m", F.create_map(F.lit(MONTH), F.unhex(F.lit(SECRET_HEX))))
    return sanitize_network_status(df, secrets="m" if keyed else None).orderBy("i").collect()


@pytest.mark.parametrize("keyed", [False, True])
def test_network_status(spark, keyed):
    (row,) = status(spark, [text(STATUS_LINES)], keyed)
    address = f"{OTHER_ADDRESS} {OTHER_PORT} 0" if keyed else "127.0.0.1 1 0"
    v6 = OTHER_ADDRESS_6 if keyed else "[fd9f:2e19:3bcf::]:1"
    assert lines(row) == [
        "@type bridge-network-status 1.2",
        STATUS_LINES[0],
        STATUS_LINES[1],
        "fingerprint " + AUTHORITY,
        f"{HASHED_R} {address}",
        "a " + v6,
        "s Running Stable Valid",
        "w Bandwidth=301",
    ]
    assert row.newest_entry == PUBLISHED


def test_network_status_variants(spark):
    own = STATUS_LINES[2:]
    variants = {
        "default time": edited(STATUS_LINES, "published "),
        "entries only": own,
        "stated authority": ["fingerprint " + AUTHORITY, *STATUS_LINES],
        "bad a line dropped": edited(STATUS_LINES, "a ", "a nonsense"),
        "no entries": STATUS_LINES[:2],
        "duplicate": [*STATUS_LINES, own[0], "s Last"],
        "other authority": ["fingerprint AAAA", *STATUS_LINES],
        "unknown line": [*STATUS_LINES, "x y"],
        "short r line": edited(STATUS_LINES, "r ", "r Heron " + unpadded(IDENTITY)[:8]),
        "bad identity": edited(STATUS_LINES, "r ", own[0].replace(" " + unpadded(IDENTITY)[:4], " R%Sn")),
    }
    rows = dict(zip(variants, status(spark, [text(v) for v in variants.values()])))
    for name in ("other authority", "unknown line", "short r line", "bad identity"):
        assert rows[name].sanitized is None and rows[name].reject_reason, name
    assert lines(rows["default time"])[1] == "published 2019-11-05 12:13:14"
    assert lines(rows["entries only"])[2] == "fingerprint " + AUTHORITY
    assert lines(rows["stated authority"]).count("fingerprint " + AUTHORITY) == 1
    assert not [x for x in lines(rows["bad a line dropped"]) if x.startswith("a ")]
    assert rows["no entries"].n_entries == 0 and rows["no entries"].newest_entry is None
    assert lines(rows["duplicate"])[-1] == "s Last"
    assert len([x for x in lines(rows["duplicate"]) if x.startswith("r ")]) == 1


def test_entries_are_sorted_by_hashed_identity(spark):
    entries = []
    for i in range(30):
        identity = f"{i:02d}" + "A" * 25
        entries.append(ENTRY.replace(unpadded(IDENTITY), identity))
    (row,) = status(spark, [text(STATUS_LINES[:2] + entries)])
    hashed = [x.split(" ")[2] for x in lines(row) if x.startswith("r ")]
    as_hex = [base64.b64decode(h + "=").hex() for h in hashed]
    assert len(hashed) == 30 and as_hex == sorted(as_hex)
