"""Document parsing at its edges: malformed lines, odd starts, truncated ends."""

import hashlib

import pytest
from pyspark.sql import functions as F
from samples import (
    EXTRA_DIGEST,
    EXTRA_INFO_LINES,
    FINGERPRINT,
    SERVER_LINES,
    signed_part,
    text,
    unpadded,
)

from descry.operators.documents import (
    classify_descriptor,
    extract_certificates,
    parse_bandwidth_header,
    parse_extra_info,
    parse_server_descriptor,
    parse_status,
    split_by_kind,
    split_descriptors,
    status_entries,
)
from descry.session import spread


def frame(spark, documents):
    rows = [(i, bytearray(d.encode("latin-1"))) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "i int, raw binary")


def r8(n):
    return f"r N{n} {unpadded(bytes([n]) * 20)} 2016-07-01 00:10:00 1.2.3.4 9001 0\n"


def r9(n):
    return (
        f"r N{n} {unpadded(bytes([n]) * 20)} {unpadded(bytes([n + 100]) * 20)} "
        "2016-07-01 00:10:00 1.2.3.4 9001 0\n"
    )


def m(n):
    return f"m {unpadded(bytes([n]) * 32)}\n"


HEAD = "network-status-version 3\nvote-status consensus\nvalid-after 2016-07-01 00:00:00\n"
MICRO = "network-status-version 3 microdesc\nvalid-after 2016-07-01 00:00:00\n"


def entries(spark, document):
    rows = status_entries(parse_status(frame(spark, [document])), ["i"]).collect()
    number = lambda hex_: bytes.fromhex(hex_)[0] if hex_ else None
    return sorted(
        ((number(r.relay_identity), number(r.server_digest), number(r.micro_digest)) for r in rows),
        key=str,
    )


@pytest.mark.parametrize(
    "document, expected",
    [
        (HEAD + r9(1) + "s X\n" + r9(2), [(1, 101, None), (2, 102, None)]),
        (HEAD + r9(1) + "r broken\n" + r9(3), [(1, 101, None)]),
        (HEAD + "r broken\n" + r9(3), []),
        (HEAD + r9(1).replace(" 0\n", " 0 0\n") + r9(2), []),
        (MICRO + r8(1) + m(11) + r8(2) + m(12), [(1, None, 11), (2, None, 12)]),
        (MICRO + r8(1) + m(11) + m(13), [(1, None, 11), (1, None, 13)]),
        # a malformed m line ends parsing, but its entry and what precedes it count
        (MICRO + r8(1) + m(11) + "m short\n" + m(14) + r8(2), [(1, None, 11)]),
        (MICRO + r8(1) + "m short\n" + r8(2) + m(12), [(1, None, None)]),
        (HEAD + r9(1) + f"m 8,9 sha256={'x' * 43}\n" + r9(2), [(1, 101, None), (2, 102, None)]),
        (HEAD + r9(1) + f"m 8,9 sha256={'x' * 42}\n" + r9(2), [(1, 101, None)]),
        (HEAD, []),
        ((HEAD + r9(1)).replace("\n", "\r\n"), [(1, 101, None)]),
        (HEAD + r9(1).rstrip("\n"), [(1, 101, None)]),
    ],
)
def test_status_entries(spark, document, expected):
    assert entries(spark, document) == expected


def test_classification(spark):
    documents = {
        HEAD: "consensus",
        MICRO: "consensus-microdesc",
        HEAD.replace("consensus", "vote"): "vote",
        "@type x 1.0\n@source y\nrouter a b\n": "server",
        "extra-info a b\n": "extra-info",
        "onion-key\n": "microdescriptor",
        "onion-key-other\n": "unknown",
        "1467331200\n": "bandwidth",
        "14673312000\n": "unknown",
        "published 2016-07-01 00:00:00\n": "bridge-status",
        "r a b c\n": "bridge-status",
        "": "unknown",
        "@type only 1.0\n": "unknown",
        "router a b": "server",
    }
    rows = classify_descriptor(frame(spark, list(documents))).orderBy("i").collect()
    assert [r.kind for r in rows] == list(documents.values())


def test_splitting(spark):
    server, extra = text(SERVER_LINES), text(EXTRA_INFO_LINES)
    cut = server[: server.index("-----END SIGNATURE")]
    documents = [
        server + "@purpose bridge\n" + server + cut,
        "@type extra-info 1.0\n" + extra * 2,
        cut,
        "onion-key\na\nonion-key\nb",
    ]
    counts = split_by_kind(frame(spark, documents)).groupBy("i").count().collect()
    assert {r.i: r["count"] for r in counts} == {0: 2, 1: 2, 3: 2}
    rows = split_descriptors(frame(spark, documents[:1]), "server").orderBy("pos").collect()
    assert [(r.pos, bytes(r.raw).decode()) for r in rows] == [(0, server), (1, server)]
    last = split_descriptors(frame(spark, documents[3:]), "microdescriptor").orderBy("pos").collect()
    assert [bytes(r.raw) for r in last] == [b"onion-key\na\n", b"onion-key\nb"]


def test_digests_keep_bytes(spark):
    odd = text([*SERVER_LINES[:-5], "contact \xe9\x85\xff", *SERVER_LINES[-5:]])
    expected = hashlib.sha1(signed_part(odd, "router ")).hexdigest()
    annotated = "@type server-descriptor 1.0\n@purpose general\n" + odd
    rows = parse_server_descriptor(frame(spark, [odd, annotated, "router x\n"])).orderBy("i").collect()
    assert [(r.i, r.digest) for r in rows] == [(0, expected), (1, expected)]
    assert rows[0].fingerprint == FINGERPRINT.lower()
    assert rows[0].extra_info_digest == EXTRA_DIGEST.hex()
    extra = "@type extra-info 1.0\n" + text(EXTRA_INFO_LINES)
    (row,) = parse_extra_info(frame(spark, [extra])).collect()
    assert row.digest == hashlib.sha1(signed_part(extra, "extra-info Heron")).hexdigest()


def test_bandwidth_headers(spark):
    created = "file_created=2016-07-01T00:30:00\n"
    documents = {
        "1467331200\n" + created + "bw=1\n": "2016-07-01 00:30:00",
        "1467331200\nbw=1\n" + created: "2016-07-01 00:00:00",
        "1467331200\nnode_id=$A bw=1\n" + created: "2016-07-01 00:00:00",
        "1467331200\n====\n" + created: "2016-07-01 00:00:00",
        "1467331200\nfile_created=nonsense\n": "2016-07-01 00:00:00",
        "nonsense\n": "2000-01-01 00:00:00",
    }
    df = frame(spark, list(documents)).withColumn("path", F.lit("a/moria/file"))
    rows = parse_bandwidth_header(df, path="path").orderBy("i").collect()
    assert [str(r.created) for r in rows] == list(documents.values())
    assert rows[0].source == "moria"
    assert rows[0].digest == hashlib.sha256(list(documents)[0].encode()).hexdigest().upper()


def test_certificates(spark):
    cert = "dir-key-certificate-version 3\nfingerprint F\ndir-key-published 2016-01-01 00:00:00\n"
    vote = HEAD.replace("consensus", "vote") + "dir-source a FP h 1.2.3.4 80 443\n" + cert
    rows = extract_certificates(frame(spark, [vote + r9(1) + r9(2), vote, HEAD + r9(1)])).collect()
    assert [(r.i, r.fingerprint, bytes(r.raw).decode()) for r in rows] == [(0, "FP", cert)]


def test_tasks_follow_the_number_of_rows(spark):
    narrow = spark.range(0, 10_000, 1, 1)
    assert spread(narrow, rows=300).rdd.getNumPartitions() == 34
    assert spread(narrow).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    split = spark.range(0, 10_000, 1, 50)
    assert spread(split, rows=300).rdd.getNumPartitions() == 50
    assert spread(spark.range(0)).count() == 0
