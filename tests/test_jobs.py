"""Jobs over files: bridges, relays, index, sync, sinks and the descriptor stream."""

import base64
import hashlib
import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from samples import (
    ADDRESS,
    ENTRY,
    EXTRA_INFO_LINES,
    MONTH,
    OTHER_ADDRESS,
    OTHER_PORT,
    PUBLISHED,
    SECRET_HEX,
    SERVER_LINES,
    STATUS_LINES,
    double_sha1,
    edited,
    signed_part,
    text,
    unpadded,
)
from test_sources import put, tarball

from descry.formats import BRIDGE_AUTHORITIES
from descry.operators.catalog import index_tree
from descry.operators.keys import accumulate
from descry.plans.bridges import run_bridges
from descry.plans.index import run_index
from descry.plans.relays import run_relays
from descry.plans.sync import run_sync
from descry.sinks.files import concat_recent, export_index_json
from descry.sinks.tables import save_state, write_new_only, write_overwrite
from descry.sources.state import read_archive, read_state
from descry.streaming.jobs import stream_descriptors

NOW = datetime(2016, 7, 1, 1, 0)


# --- sinks ---------------------------------------------------------------------------


def test_first_write_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k int, v string, m string"
    one = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "c", "y")], schema)
    assert write_new_only(one, path, ["k"], ["v"], ["m"]).count() == 2
    assert write_new_only(one, path, ["k"], ["v"], ["m"]).count() == 0
    two = spark.createDataFrame([(1, "z", "x"), (3, "d", "y")], schema)
    written = write_new_only(two, path, ["k"], ["v"], ["m"])
    assert [tuple(r) for r in written.collect()] == [(3, "d", "y")]
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [
        (1, "a"),
        (2, "c"),
        (3, "d"),
    ]


def test_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k int, v string, m string"
    write_overwrite(
        spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], schema), path, ["k"], ["v"], ["m"]
    )
    write_overwrite(
        spark.createDataFrame([(1, "q", "x"), (4, "r", "z"), (4, "s", "z")], schema), path, ["k"], ["v"], ["m"]
    )
    assert sorted((r.k, r.v, r.m) for r in spark.read.parquet(path).collect()) == [
        (1, "q", "x"),
        (2, "b", "x"),
        (3, "c", "y"),
        (4, "s", "z"),
    ]


def test_state_is_replaced_or_accumulated(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "k string"
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], schema)
    save_state(keys("a", "b"), path, NOW)
    save_state(keys("c"), path, NOW + timedelta(hours=1))
    assert [r.k for r in read_state(spark, path, schema).collect()] == ["c"]
    both = accumulate(read_state(spark, path, schema), keys("d"), ["k"])
    save_state(both, path, NOW + timedelta(hours=2))
    assert sorted(r.k for r in read_state(spark, path, schema).collect()) == ["c", "d"]


def test_two_versions_of_a_state_are_kept(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "k int"
    for i in range(5):
        save_state(spark.createDataFrame([(i,)], schema), path, NOW + timedelta(hours=i))
    assert len(list((tmp_path / "s").glob("run=*"))) == 2
    assert [r.k for r in read_state(spark, path, schema).collect()] == [4]


def test_recent_files_keep_bytes_and_order(spark, tmp_path):
    rows = [("r/one", i, bytearray(f"doc {i} \xe9\n".encode("latin-1"))) for i in range(50)]
    df = spark.createDataFrame(rows, "recent_path string, i int, raw binary").repartition(5)
    concat_recent(df, str(tmp_path / "out"), ["i"])
    (folder,) = (tmp_path / "out").glob("recent_path=*")
    data = b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))
    assert data == b"".join(bytes(r[2]) for r in rows)


# --- bridges -------------------------------------------------------------------------


BRIDGES_NOW = datetime(2019, 11, 6, 1, 0)


def bridge_folder(tmp_path):
    bad = text(edited(SERVER_LINES, "uptime", "unknown 1"))
    members = {
        "bridge-descriptors": text(SERVER_LINES) * 2 + bad,
        "cached-extrainfo": text(EXTRA_INFO_LINES),
        "cached-extrainfo.new": text(EXTRA_INFO_LINES),
        "networkstatus-bridges": text(STATUS_LINES),
    }
    put(tmp_path, "in/from-tonga-2019-11-06T000702Z.tar.gz", tarball(members))
    put(tmp_path, "in/from-serge-2019-11-06T000703Z.tar.gz", b"damaged")
    return str(tmp_path / "in")


def test_bridges(spark, tmp_path):
    folder, archive, state = bridge_folder(tmp_path), str(tmp_path / "a"), str(tmp_path / "s")
    written, rejected, secrets = run_bridges(spark, folder, archive, state, BRIDGES_NOW)
    assert secrets is None
    d = double_sha1(text(SERVER_LINES), "router ")
    e = double_sha1(text(EXTRA_INFO_LINES), "extra-info ")
    assert sorted(r.storage_path for r in written.collect()) == [
        f"bridge-descriptors/2019/11/extra-infos/{e[0]}/{e[1]}/{e}",
        f"bridge-descriptors/2019/11/server-descriptors/{d[0]}/{d[1]}/{d}",
        f"bridge-descriptors/2019/11/statuses/05/20191105-091011-{BRIDGE_AUTHORITIES['tonga']}",
    ]
    assert [(r.kind, r.reject_reason) for r in rejected.collect()] == [
        ("bridge-server", "unrecognized line")
    ]
    assert [r.tarball for r in read_state(spark, state, "tarball string").collect()] == [
        "from-tonga-2019-11-06T000702Z.tar.gz"
    ]
    # the tarball is remembered, and even read again it adds nothing
    again, _, _ = run_bridges(spark, folder, archive, state, BRIDGES_NOW + timedelta(hours=1))
    assert again.count() == 0
    again, _, _ = run_bridges(spark, folder, archive, str(tmp_path / "s2"), BRIDGES_NOW)
    assert again.count() == 0
    assert read_archive(spark, archive, ["bridge-server"], [MONTH]).count() == 1
    assert read_archive(spark, archive, ["bridge-server"], ["2019-12"]).count() == 0


def test_bridges_keyed(spark, tmp_path):
    folder = bridge_folder(tmp_path)
    secrets = spark.createDataFrame([(MONTH, bytearray.fromhex(SECRET_HEX))], "month string, secret binary")
    written, _, persist = run_bridges(
        spark, folder, str(tmp_path / "a"), str(tmp_path / "s"), BRIDGES_NOW, secrets
    )
    texts = "".join(bytes(r.raw).decode() for r in written.collect())
    assert f"router Heron {OTHER_ADDRESS} {OTHER_PORT} 0 0" in texts
    assert f"{PUBLISHED} {OTHER_ADDRESS} {OTHER_PORT} 0" in texts
    assert ADDRESS not in texts
    assert [r.month for r in persist.collect()] == [MONTH]


def test_invented_months_are_rejected(spark, tmp_path):
    entries = [
        ENTRY.replace(PUBLISHED, f"{1000 + i // 12}-{1 + i % 12:02d}-01 00:00:00") for i in range(2000)
    ]
    odd = text([*STATUS_LINES[:2], *entries])
    members = {"networkstatus-bridges": odd, "bridge-descriptors": text(SERVER_LINES)}
    put(tmp_path, "in/from-tonga-2019-11-06T000702Z.tar.gz", tarball(members))
    secrets = spark.createDataFrame([], "month string, secret binary")
    written, rejected, persist = run_bridges(
        spark, str(tmp_path / "in"), str(tmp_path / "a"), str(tmp_path / "s"), BRIDGES_NOW, secrets
    )
    assert [r.kind for r in written.collect()] == ["bridge-server"]
    assert [r.reject_reason for r in rejected.collect()] == ["month out of range"]
    assert [r.month for r in persist.collect()] == [MONTH]


# --- relays --------------------------------------------------------------------------


def relay_folder(tmp_path):
    server, extra = text(SERVER_LINES), text(EXTRA_INFO_LINES)
    digest = hashlib.sha1(signed_part(server, "router ")).digest()
    micro = "onion-key\n-----BEGIN RSA PUBLIC KEY-----\nx\n-----END RSA PUBLIC KEY-----\n"
    other = micro.replace("x", "unreferenced")
    identity = unpadded(b"i" * 20)
    r9 = f"r A {identity} {unpadded(digest)} 2016-07-01 00:10:00 1.2.3.4 9001 0\n"
    r9b = f"r B {unpadded(b'j' * 20)} {unpadded(b'd' * 20)} 2016-07-01 00:20:00 1.2.3.4 9001 0\n"
    m = unpadded(hashlib.sha256(micro.encode()).digest())
    head = "valid-after 2016-07-01 00:00:00\n"
    source = "dir-source auth AUTHFP h 1.2.3.4 80 443\n"
    put(tmp_path, "in/consensus", "network-status-version 3\nvote-status consensus\n" + head + source
        + "vote-digest AA\n" + r9 + "s Running\n" + r9b + "directory-signature x y\n")
    put(tmp_path, "in/micro-consensus", "network-status-version 3 microdesc\n" + head
        + f"r A {identity} 2016-07-01 00:10:00 1.2.3.4 9001 0\nm {m}\n")
    put(tmp_path, "in/vote", "@type network-status-vote-3 1.0\nnetwork-status-version 3\nvote-status vote\n"
        + head + source + "dir-key-certificate-version 3\nfingerprint VOTEFP\n"
        + "dir-key-published 2016-01-01 00:00:00\ndir-key-certification\n" + r9
        + f"m 8,9 sha256={'x' * 43}\ndirectory-signature x y\n")
    put(tmp_path, "in/servers", server * 2)
    put(tmp_path, "in/extras", extra)
    put(tmp_path, "in/micros", micro + other)
    put(tmp_path, "in/moria/bandwidth", "1467331200\nversion=1.0\nfile_created=2016-07-01T00:30:00\nbw=1\n")
    return str(tmp_path / "in"), digest.hex(), hashlib.sha256(micro.encode()).hexdigest()


def test_relays(spark, tmp_path):
    folder, s, m = relay_folder(tmp_path)
    archive = str(tmp_path / "a")
    written, report, weight = run_relays(spark, folder, archive, NOW)
    rows = {r.storage_path: bytes(r.raw).decode() for r in written.collect()}
    e = hashlib.sha1(signed_part(text(EXTRA_INFO_LINES), "extra-info ")).hexdigest()
    vote = [p for p in rows if "/vote/" in p]
    bandwidth = [p for p in rows if "/bandwidth/" in p]
    assert set(rows) == {
        "relay-descriptors/consensus/2016/07/01/2016-07-01-00-00-00-consensus",
        "relay-descriptors/microdesc/2016/07/consensus-microdesc/01/"
        "2016-07-01-00-00-00-consensus-microdesc",
        f"relay-descriptors/server-descriptor/2019/11/{s[0]}/{s[1]}/{s}",
        f"relay-descriptors/extra-info/2019/11/{e[0]}/{e[1]}/{e}",
        f"relay-descriptors/microdesc/2016/07/micro/{m[0]}/{m[1]}/{m}",
        "relay-descriptors/certs/AUTHFP-2016-01-01-00-00-00",
        *vote,
        *bandwidth,
    }
    assert vote[0].startswith(
        "relay-descriptors/vote/2016/07/01/2016-07-01-00-00-00-vote-AUTHFP-"
    ) and len(vote) == 1
    assert bandwidth[0].startswith(
        "relay-descriptors/bandwidth/2016/07/01/2016-07-01-00-30-00-bandwidth-moria-"
    )
    assert rows[bandwidth[0]].startswith("@type bandwidth-file 1.0\n@source moria\n1467331200\n")
    assert rows[vote[0]].startswith("@type network-status-vote-3 1.0\nnetwork-status-version 3")
    assert all(r.startswith("@type ") for r in rows.values())

    found = {r.kind: r for r in report.collect()}
    c = found["consensus"]
    assert (c.found_s, c.all_s, c.found_v, c.all_v) == (1, 2, 1, 1)
    assert c.missing_descriptors and not c.missing_votes and not c.missing_microdesc_consensus
    assert (found["vote"].found_s, found["vote"].all_s) == (1, 1)
    assert found["consensus-microdesc"].found_m == 1
    w = weight.first()
    # the second server descriptor of the consensus, and the first one's extra-info
    assert w.n_missing == 3 and w.alert and round(w.missing_weight, 3) == 101.01
    again, _, _ = run_relays(spark, folder, archive, NOW)
    assert again.count() == 0


def test_sync(spark, tmp_path):
    folder, _, _ = relay_folder(tmp_path)
    remote, local = str(tmp_path / "remote"), str(tmp_path / "local")
    run_relays(spark, folder, remote, NOW)
    assert run_sync(spark, remote, local, ["server", "vote"]).count() == 2
    assert run_sync(spark, remote, local, ["server", "vote", "consensus"]).count() == 1
    assert run_sync(spark, remote, local).count() == 5
    assert run_sync(spark, remote, local).count() == 0
    assert read_archive(spark, local).count() == 8


# --- index ---------------------------------------------------------------------------


def set_time(path, when):
    stamp = (when - datetime(1970, 1, 1)).total_seconds()
    os.utime(path, (stamp, stamp))


def test_index_over_several_runs(spark, tmp_path):
    server = "@type server-descriptor 1.0\n" + text(SERVER_LINES)
    start = datetime(2018, 1, 1)
    one = put(tmp_path, "d/x/one", server + server.replace(PUBLISHED, "2019-12-05 07:08:09"))
    two = put(tmp_path, "d/two", "@type extra-info 1.0\n" + text(EXTRA_INFO_LINES))
    put(tmp_path, "d/.hidden", server)
    put(tmp_path, "d/three.tmp", server)
    for p in (one, two):
        set_time(p, start)
    folder, state, out = str(tmp_path / "d"), str(tmp_path / "s"), str(tmp_path / "json")

    def run(now):
        rows = run_index(spark, folder, state, now, out).collect()
        return {r.path.rsplit("/", 1)[1]: r for r in rows}

    index = run(start)
    assert set(index) == {"one", "two"}
    data = one.read_bytes()
    assert index["one"].size == len(data)
    assert index["one"].sha256 == base64.b64encode(hashlib.sha256(data).digest()).decode()
    assert index["one"].types == ["server-descriptor 1.0"]
    assert str(index["one"].first_published) == PUBLISHED
    assert str(index["one"].last_published) == "2019-12-05 07:08:09"

    # one changes, two vanishes: marked, then gone after two hours
    one.write_bytes(server.encode())
    set_time(one, start + timedelta(minutes=5))
    aside = two.read_bytes()
    two.unlink()
    index = run(start + timedelta(hours=1))
    assert index["one"].size == len(server)
    assert index["two"].marked_for_deletion == start + timedelta(hours=1)
    index = run(start + timedelta(hours=2))
    assert index["two"].marked_for_deletion == start + timedelta(hours=1)
    # it comes back unchanged: unmarked
    two.write_bytes(aside)
    set_time(two, start)
    index = run(start + timedelta(hours=2, minutes=30))
    assert index["two"].marked_for_deletion is None
    two.unlink()
    run(start + timedelta(hours=3))
    assert set(run(start + timedelta(hours=5, minutes=1))) == {"one"}
    parts = sorted((tmp_path / "json" / "none").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert document["directories"][0]["path"] == "x"
    assert document["directories"][0]["files"][0]["path"] == "one"


def nested(paths):
    tree = {}
    for path in paths:
        *folders, name = path.split("/")
        node = tree
        for folder in folders:
            node = node.setdefault("dirs", {}).setdefault(folder, {})
        node.setdefault("files", []).append(name)

    def build(node):
        out = {}
        if "files" in node:
            out["files"] = sorted(node["files"])
        if "dirs" in node:
            out["directories"] = {k: build(v) for k, v in node["dirs"].items()}
        return out

    return build(tree)


def simplified(node):
    out = {}
    if "files" in node:
        out["files"] = [f["path"] for f in node["files"]]
    if "directories" in node:
        out["directories"] = {d["path"]: simplified(d) for d in node["directories"]}
    return out


def test_index_json_is_nested(spark, tmp_path):
    paths = ["top", "a/1", "a/2", "a/b/c/deep", "a-b/x", "a/b-c/y", 'q"uote/z', "é/ü", "zz/top"]
    rows = [(p, 5, datetime(2018, 1, 1), [], None) for p in paths]
    rows += [("a/unindexed", 5, None, [], None), ("a/gone", 5, NOW, [], NOW)]
    df = spark.createDataFrame(
        rows,
        "path string, size bigint, last_modified timestamp, types array<string>, "
        "marked_for_deletion timestamp",
    )
    export_index_json(df, str(tmp_path / "out"), "2018-01-01 00:00", "https://example.org")
    for codec, opener in (("none", open), ("gzip", __import__("gzip").open), ("bzip2", __import__("bz2").open)):
        parts = sorted((tmp_path / "out" / codec).glob("part-*"))
        document = json.loads("".join(opener(p, "rt", encoding="utf-8").read() for p in parts))
        assert document["index_created"] == "2018-01-01 00:00"
        assert document["path"] == "https://example.org"
        assert simplified(document) == nested(paths)
    assert "types" not in document["files"][0]
    assert index_tree(df.limit(0)).count() == 0
    export_index_json(df.limit(0), str(tmp_path / "empty"), "2018-01-01 00:00")
    text_ = "".join(p.read_text() for p in sorted((tmp_path / "empty" / "none").glob("part-*")))
    assert json.loads(text_) == {"index_created": "2018-01-01 00:00"}


# --- stream --------------------------------------------------------------------------


def test_descriptor_stream(spark, tmp_path):
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "cp")
    put(tmp_path, "in/a", text(SERVER_LINES) * 2)
    put(tmp_path, "in/b", text(SERVER_LINES) + text(edited(SERVER_LINES, "uptime", "uptime 7")))
    for _ in range(2):
        stream_descriptors(spark, str(tmp_path / "in"), table, checkpoint, 1).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    put(tmp_path, "in/c", text(EXTRA_INFO_LINES) + text(EXTRA_INFO_LINES))
    stream_descriptors(spark, str(tmp_path / "in"), table, checkpoint, 1).awaitTermination()
    counts = spark.read.parquet(table).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.kind: r.n for r in counts} == {"server": 2, "extra-info": 1}


def test_a_later_copy_replaces_a_status(spark, tmp_path):
    folder, _, _ = relay_folder(tmp_path)
    archive = str(tmp_path / "a")
    run_relays(spark, folder, archive, NOW)
    path = tmp_path / "in" / "consensus"
    path.write_text(path.read_text().replace("s Running", "s Running Fast"))
    written, _, _ = run_relays(spark, folder, archive, NOW + timedelta(hours=1))
    assert [r.kind for r in written.collect()] == ["consensus"]
    (row,) = read_archive(spark, archive, ["consensus"]).collect()
    assert b"s Running Fast" in bytes(row.raw)
    assert read_archive(spark, archive).count() == 8
