"""Readers of descriptor files, tarballs, lists, timings, statistics and secrets."""

import bz2
import gzip
import io
import json
import lzma
import tarfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from samples import EXTRA_INFO_LINES, SECRET_HEX, SERVER_LINES, text

from descry.operators.documents import split_by_kind
from descry.operators.secrets import ensure_secrets, with_month_secret
from descry.operators.transfers import validate_transfer_analysis, validate_transfers
from descry.sources.files import (
    read_bridge_tarballs,
    read_cached_descriptors,
    read_descriptor_files,
)
from descry.sources.listings import (
    read_distributor_metrics,
    read_exit_lists,
    read_pool_assignments,
    read_proxy_stats,
    read_tpf,
    read_transfer_analysis,
)
from descry.sources.state import read_edges, read_ip_secrets, read_state, read_table


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return path


def test_descriptor_files(spark, tmp_path):
    put(tmp_path, "a/one", text(SERVER_LINES) * 2 + "router truncated\n")
    put(tmp_path, "a/two.bz2", bz2.compress(text(EXTRA_INFO_LINES).encode()))
    put(tmp_path, "a/left-out.tar.bz2", bz2.compress(b"x"))
    put(tmp_path, "a/seen", text(SERVER_LINES))
    files = read_descriptor_files(spark, str(tmp_path)).cache()
    assert files.count() == 3
    history = files.filter(F.col("path").endswith("seen")).select("path")
    fresh = read_descriptor_files(spark, str(tmp_path), history)
    documents = split_by_kind(fresh).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in documents} == {"server": 2, "extra-info": 1}


def test_too_many_unreadable_files_stop_the_run(spark, tmp_path):
    for i in range(3):
        put(tmp_path, f"bad{i}.bz2", b"broken")
    assert read_descriptor_files(spark, str(tmp_path)).count() == 0
    put(tmp_path, "bad3.bz2", b"broken")
    with pytest.raises(OSError):
        read_descriptor_files(spark, str(tmp_path))


def test_cached_descriptors(spark, tmp_path):
    put(tmp_path, "cached-consensus", "network-status-version 3\nvote-status consensus\n")
    vote = "network-status-version 3\nvote-status vote\nx\n"
    put(tmp_path, "v3-status-votes", vote * 3)
    put(tmp_path, "cached-descriptors.new", text(SERVER_LINES) * 2)
    put(tmp_path, "cached-extrainfo", text(EXTRA_INFO_LINES))
    put(tmp_path, "other", text(SERVER_LINES))
    rows = read_cached_descriptors(spark, [str(tmp_path)])
    counts = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert counts == {"consensus": 1, "vote": 3, "server": 2, "extra-info": 1}
    votes = rows.filter("kind = 'vote'").select("raw").distinct().collect()
    assert [bytes(r.raw).decode() for r in votes] == [vote]


def tarball(members, mode="w:gz"):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=mode) as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data.encode()))
    return buffer.getvalue()


def test_bridge_tarballs(spark, tmp_path):
    members = {"bridge-descriptors": text(SERVER_LINES), "cached-extrainfo.new": ""}
    put(tmp_path, "from-tonga-2016-07-01T000702Z.tar.gz", tarball(members))
    put(tmp_path, "x/from-serge-2016-07-02T000702Z.tar", tarball(members, "w"))
    put(tmp_path, "from-unknown-2016-07-01T000702Z.tar.gz", tarball(members))
    put(tmp_path, "from-tonga-2016-07-01.tar.gz", tarball(members))
    put(tmp_path, "from-tonga-2016-07-03T000702Z.tar.gz", b"broken")
    rows = read_bridge_tarballs(spark, str(tmp_path)).collect()
    assert {(r.tarball, r.default_published, r.member) for r in rows} == {
        ("from-tonga-2016-07-01T000702Z.tar.gz", "2016-07-01 00:07:02", "bridge-descriptors"),
        ("from-serge-2016-07-02T000702Z.tar", "2016-07-02 00:07:02", "bridge-descriptors"),
    }
    done = spark.createDataFrame([("from-serge-2016-07-02T000702Z.tar",)], "tarball string")
    assert read_bridge_tarballs(spark, str(tmp_path), done).count() == 1


def test_pool_assignments(spark, tmp_path):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    first = f"bridge-pool-assignment 2016-04-09 00:29:37\n{a} email\n{b} https ring=1\n{a} moat\n"
    second = f"bridge-pool-assignment 2016-04-10 00:29:37\n{c} x\n"
    put(tmp_path, "assignments.log", first + second)
    put(tmp_path, "assignments.log-2.gz", gzip.compress((first + "short\n" + second).encode()))
    put(tmp_path, "assignments.log-3", f"{a} early\n" + first)
    put(tmp_path, "assignments.log-4", second + "bridge-pool-assignment nonsense\n" + first)
    put(tmp_path, "assignments.log-5", first + first.replace("email", "x") + f"{c} y\n")
    put(tmp_path, "other.log", first)
    rows = read_pool_assignments(spark, str(tmp_path)).collect()
    by_file = {}
    for r in rows:
        key = (r.published.day, r.fingerprint[0])
        by_file.setdefault(r.path.rsplit("/", 1)[1], {})[key] = r.details
    group = {(9, "a"): "moat", (9, "b"): "https ring=1"}
    assert by_file == {
        "assignments.log": {**group, (10, "c"): "x"},
        "assignments.log-2.gz": group,
        "assignments.log-4": {(10, "c"): "x"},
        "assignments.log-5": {**group, (9, "c"): "y"},
    }


def test_exit_lists(spark, tmp_path):
    node = (
        "ExitNode AAAA\nPublished 2016-09-19 01:00:00\nLastStatus 2016-09-19 02:00:00\n"
        "ExitAddress 1.2.3.4 2016-09-19 03:00:00\nExitAddress 1.2.3.5 2016-09-19 04:00:00\n"
    )
    head = "@type tordnsel 1.0\nDownloaded 2016-09-20 13:02:00\n"
    put(tmp_path, "good", head + node)
    put(tmp_path, "plain", node)
    put(tmp_path, "two", head + node + "Downloaded 2016-09-21 13:02:00\n" + node)
    put(tmp_path, "foreign", head + node + "router x\n")
    rows = read_exit_lists(spark, str(tmp_path), datetime(2020, 1, 1)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.address, r.downloaded.year) for r in rows) == [
        ("good", "1.2.3.4", 2016),
        ("good", "1.2.3.5", 2016),
        ("plain", "1.2.3.4", 2020),
        ("plain", "1.2.3.5", 2020),
    ]


def test_timings(spark, tmp_path):
    row = "SOURCE={s} FILESIZE={n} START={t}.25 A=1 A=2\n"
    good = "@type torperf 1.1\n" + row.format(s="op-nl", n=1048576, t=1491868800)
    put(tmp_path, "op-nl-1048576-2017-04-11.tpf", good * 2)
    put(tmp_path, "siv-51200-2017-04-11.tpf", good)
    put(tmp_path, "op-nl-1048576-2017-04-12.tpf", good)
    put(tmp_path, "op-nl-51200-2017-04-11.tpf", row.format(s="op-nl", n=51200, t=1491868800) + good)
    rows = read_tpf(spark, str(tmp_path))
    assert rows.count() == 6
    valid = validate_transfers(rows).select("path").collect()
    assert [r.path.rsplit("/", 1)[1] for r in valid] == ["op-nl-1048576-2017-04-11.tpf"] * 2
    assert rows.first().kv["A"] == "2"


def test_transfer_analysis(spark, tmp_path):
    def document(source):
        transfers = {"t1": {"filesize_bytes": 5, "unix_ts_start": 1491868800.5}, "t2": {}}
        data = {source: {"tgen": {"transfers": transfers}}}
        return lzma.compress(json.dumps({"type": "x", "data": data}).encode())

    put(tmp_path, "2017-04-11.op-nl.onionperf.analysis.json.xz", document("op-nl"))
    put(tmp_path, "2017-04-12.op-us.onionperf.analysis.json.xz", document("other"))
    put(tmp_path, "2017-04-13.op-us.onionperf.analysis.json.xz", b"broken")
    rows = read_transfer_analysis(spark, str(tmp_path))
    assert rows.count() == 4
    valid = validate_transfer_analysis(rows).orderBy("transfer_id").collect()
    assert [(r.source, r.transfer_id, r.filesize) for r in valid] == [
        ("op-nl", "t1", 5),
        ("op-nl", "t2", None),
    ]


def test_statistics(spark, tmp_path):
    stats = "@type snowflake-stats 1.0\nsnowflake-stats-end 2020-01-0{} 00:00:00 (86400 s)\nx 1\n"
    put(tmp_path, "s/one", "".join(stats.format(i) for i in (1, 2, 3)))
    rows = read_proxy_stats(spark, str(tmp_path / "s")).collect()
    assert sorted(r.stats_end.day for r in rows) == [1, 2, 3]
    put(tmp_path, "m/good", "bridgedb-metrics-end 2020-01-01 00:00:00 (86400 s)\nx 1\n")
    put(tmp_path, "m/bad", "router x\n")
    good, rejected = read_distributor_metrics(spark, str(tmp_path / "m"))
    assert [r.metrics_end.year for r in good.collect()] == [2020]
    assert [r.path.rsplit("/", 1)[1] for r in rejected.collect()] == ["bad"]


def test_secrets(spark, tmp_path):
    path = put(tmp_path, "secrets", f"2016-05,{'ab' * 31}\n2016-06,{'00' * 83}\n2016-06,{SECRET_HEX}\n")
    secrets = read_ip_secrets(spark, str(path))
    found = {r.month: bytes(r.secret).hex() for r in secrets.collect()}
    assert found == {"2016-05": "ab" * 31, "2016-06": SECRET_HEX}
    for i, bad in enumerate(["2016-07,abcd", "nonsense", "2016-07," + "zz" * 83, "x," + "ab" * 31]):
        damaged = put(tmp_path, f"damaged{i}", f"2016-06,{SECRET_HEX}\n{bad}\n")
        with pytest.raises(ValueError):
            read_ip_secrets(spark, str(damaged))


def test_new_secrets_keep_prefixes(spark, tmp_path):
    path = put(tmp_path, "secrets", f"2016-05,{'ab' * 31}\n2016-06,{SECRET_HEX}\n")
    months = spark.createDataFrame([("2016-05",), ("2016-06",), ("1999-01",)], "month string")
    everything, persist = ensure_secrets(
        months, read_ip_secrets(spark, str(path)), datetime(2016, 5, 20)
    )
    found = {r.month: bytes(r.secret) for r in everything.collect()}
    assert {m: len(s) for m, s in found.items()} == dict.fromkeys(found, 83)
    assert found["2016-05"][:31].hex() == "ab" * 31 and found["2016-06"].hex() == SECRET_HEX
    # the cut-off's own month is kept
    assert sorted(r.month for r in persist.collect()) == ["2016-05", "2016-06"]
    again = {r.month: bytes(r.secret) for r in everything.collect()}
    assert again == found
    rows = spark.createDataFrame([("2016-05-03 00:00:00",), ("2017-01-01 00:00:00",)], "t string")
    joined = with_month_secret(rows.withColumn("t", F.to_timestamp("t")), everything, "t").collect()
    assert [r.secret is None for r in sorted(joined, key=lambda r: r.t)] == [False, True]


def test_edges(spark, tmp_path):
    edge = {"referencing": "A", "referenced": "B", "weight": 0.5, "expiresAfterMillis": 1467331200000}
    good = put(tmp_path, "good", json.dumps([edge, {**edge, "referencing": "C"}]))
    rows = read_edges(spark, str(good)).collect()
    assert [(r.referencing, r.referenced, r.weight, r.expires_at.year) for r in rows] == [
        ("A", "B", 0.5, 2016),
        ("C", "B", 0.5, 2016),
    ]
    for i, damaged in enumerate(("", "{", "[{xx", '"x"')):
        assert read_edges(spark, str(put(tmp_path, f"bad{i}", damaged))).count() == 0
    assert read_edges(spark, str(tmp_path / "none")).count() == 0


def test_missing_tables_are_empty(spark, tmp_path):
    assert read_table(spark, str(tmp_path / "none"), "a int").count() == 0
    assert read_state(spark, str(tmp_path / "none"), "a int").count() == 0
