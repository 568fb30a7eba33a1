"""State of the relay job over runs, bucketed tables, pruned stores, syncing by files."""

import hashlib
import json
import os
from datetime import datetime, timedelta

import pytest
from samples import SERVER_LINES, edited, signed_part, text, unpadded
from test_jobs import NOW, relay_folder
from test_sources import put

from descry.operators.keys import skip_processed
from descry.plans.relay_state import BEGINNING, RelayState
from descry.plans.relays import continue_relays, run_relays
from descry.plans.sync import continue_sync
from descry.sinks.archive import PARTITIONS, store_documents
from descry.sinks.buckets import BucketedState
from descry.sinks.files import export_edges
from descry.sinks.tables import touched_by
from descry.sources.files import list_descriptor_files
from descry.sources.state import folder_names, read_archive, read_edges

HOUR = timedelta(hours=1)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def explained(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


# --- tables by day -------------------------------------------------------------------


def test_bucketed_state(spark, tmp_path):
    table = BucketedState(str(tmp_path / "t"), "k string, v int, t timestamp", ("k",), "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int, t timestamp")
    day = datetime(2020, 5, 1, 12)
    first = frame(("a", 1, day), ("a", 0, day + HOUR), ("b", 2, day + timedelta(days=2)), ("old", 3, day - HOUR))
    far = day + timedelta(days=366)
    assert rows_of(table.insert(first, day, far), "k", "v") == [("a", 0), ("b", 2)]
    # what is stored wins, whatever day the new row has; a repeated run adds nothing
    assert table.insert(first, day, far).count() == 0
    second = frame(("a", 9, day + timedelta(days=1)), ("c", 4, day + HOUR), ("far", 5, day + timedelta(days=999)))
    assert rows_of(table.insert(second, day, far), "k", "v") == [("c", 4)]
    assert table.days(spark) == ["2020-05-01", "2020-05-03"]
    assert rows_of(table.read(spark, day + 2 * HOUR), "k") == [("b",)]
    assert table.expire(spark, datetime(2020, 5, 2, 1)) == ["2020-05-01"]
    assert rows_of(table.read(spark, day), "k") == [("b",)]


def test_earlier_days_are_not_opened(spark, tmp_path):
    table = BucketedState(str(tmp_path / "t"), "k string, t timestamp", ("k", "t"), "t", timed=True)
    days = [datetime(2020, 5, d, 1) for d in range(1, 6)]
    table.insert(spark.createDataFrame([("k", d) for d in days], "k string, t timestamp"), days[0])
    read = table.read(spark, days[3])
    assert len(read.inputFiles()) >= 2  # the files of the table
    assert "PartitionFilters: [isnotnull(bucket" in explained(spark, read)
    assert rows_of(read, "t") == [(days[3],), (days[4],)]


def test_days_of_many_files_are_put_together(spark, tmp_path):
    table = BucketedState(str(tmp_path / "t"), "k string, t timestamp", ("k",), "t")
    day = datetime(2020, 5, 1, 12)
    for k in "abcd":
        table.insert(spark.createDataFrame([(k, day)], "k string, t timestamp"), day)
    table.insert(spark.createDataFrame([("e", day + timedelta(days=1))], "k string, t timestamp"), day)
    before = rows_of(table.read(spark, day), "k", "t")
    assert table.compact(spark, most_files=3) == ["2020-05-01"]
    assert table.compact(spark, most_files=3) == []
    assert rows_of(table.read(spark, day), "k", "t") == before and len(before) == 5


# --- the relay job over runs ----------------------------------------------------------


def consensus(entries, hour="00"):
    lines = "".join(
        f"r N{i} {unpadded(fp)} {unpadded(digest)} 2016-07-01 00:10:00 1.2.3.4 9001 0\ns Running\n"
        for i, (fp, digest) in enumerate(entries)
    )
    return (
        f"network-status-version 3\nvote-status consensus\nvalid-after 2016-07-01 {hour}:00:00\n"
        + lines + "directory-signature x y\n"
    )


def server(fp, **changes):
    lines = edited(SERVER_LINES, "published", "published 2016-07-01 00:10:00")
    lines = edited(lines, "fingerprint", "fingerprint " + " ".join(fp.hex().upper()[i : i + 4] for i in range(0, 40, 4)))
    for key, value in changes.items():
        lines = edited(lines, key, value)
    return text(lines)


def digest_of(document):
    return hashlib.sha1(signed_part(document, "router ")).digest()


@pytest.fixture
def relays(spark, tmp_path):
    state, archive, folder = RelayState(str(tmp_path / "s")), str(tmp_path / "a"), str(tmp_path / "in")

    def run(now, **more):
        return continue_relays(spark, folder, archive, state, now, **more)

    return run, state


def test_servers_come_after_the_status_that_names_them(spark, tmp_path, relays):
    run, state = relays
    a, b = b"a" * 20, b"b" * 20
    of_a, of_b = server(a), server(b, uptime="uptime 9")
    put(tmp_path, "in/consensus", consensus([(a, digest_of(of_a)), (b, digest_of(of_b))]))
    first = run(NOW)
    (status,) = first.report.collect()
    assert (status.found_s, status.all_s) == (0, 2)
    w = first.weight.first()
    # both servers, and the status of the other flavour
    assert w.n_missing == 3 and round(w.missing_weight, 6) == 201.0
    want = {r.digest for r in first.work.filter("type = 'server'").collect()}
    assert want == {digest_of(of_a).hex(), digest_of(of_b).hex()}
    (asked,) = first.requests.filter("type = 'server'").collect()
    assert asked.keys == "+".join(sorted(want))

    # one server arrives: its key is seen, its edge no longer missing, the extra-info is
    put(tmp_path, "in/server-a", of_a)
    second = run(NOW + HOUR)
    assert second.report.count() == 0  # no new status
    w = second.weight.first()
    assert w.n_missing == 3 and round(w.missing_weight, 6) == round(100 + 1 + 0.01, 6)
    left = second.work.filter("type = 'server' AND parsed_at IS NULL").collect()
    assert [r.digest for r in left] == [digest_of(of_b).hex()]
    assert second.requests.filter("type = 'extra'").count() == 1

    # nothing new, and after three hours the status' edges have expired, those of the server not
    third = run(NOW + 3 * HOUR)
    assert third.written.count() == 0 and third.report.count() == 0
    kept = rows_of(state.edges.read(spark, NOW + 3 * HOUR), "referencing")
    assert kept == [("S-" + digest_of(of_a).hex().upper(),)]
    assert third.weight.first().n_missing == 1
    # the key that landed has the time it was seen at, the statuses of past hours are gone
    seen = third.work.filter("type = 'server' AND parsed_at IS NOT NULL").collect()
    assert [(r.digest, r.parsed_at) for r in seen] == [(digest_of(of_a).hex(), NOW + HOUR)]
    assert {r.time for r in third.work.filter("type = 'consensus'").collect()} == {NOW + 3 * HOUR}


def test_a_status_finds_servers_of_runs_before(spark, tmp_path, relays):
    run, state = relays
    a = b"a" * 20
    of_a = server(a)
    put(tmp_path, "in/server-a", of_a)
    assert run(NOW - HOUR).report.count() == 0
    (tmp_path / "in" / "server-a").unlink()  # the file goes, its digest is known
    put(tmp_path, "in/consensus", consensus([(a, digest_of(of_a))]))
    (status,) = run(NOW).report.collect()
    assert (status.found_s, status.all_s, status.missing_descriptors) == (1, 1, True)  # its extra-info
    # two days on, digests are forgotten
    later = NOW + timedelta(days=3)
    none = state.servers.read(spark, NOW).limit(0)
    known, _, _ = state.remember_documents(
        none, none.select("digest", "published"),
        spark.createDataFrame([], "digest string, valid_after timestamp"), later,
    )
    assert known.count() == 0 and state.servers.days(spark) == []


def test_a_file_written_again_is_read_again(spark, tmp_path):
    state, folder = RelayState(str(tmp_path / "s")), str(tmp_path / "in")
    path = put(tmp_path, "in/x", "one")
    put(tmp_path, "in/left-out.tar.bz2", "x")
    listed = list_descriptor_files(spark, folder)
    state.files.insert(listed, BEGINNING)
    assert list_descriptor_files(spark, folder, state.files.read(spark, BEGINNING)).count() == 0
    os.utime(path, (2_000_000_000, 2_000_000_000))
    put(tmp_path, "in/y", "two")
    new = list_descriptor_files(spark, folder, state.files.read(spark, BEGINNING)).collect()
    assert sorted(r.path[-1] for r in new) == ["x", "y"]


def test_edges_as_json(spark, tmp_path):
    state, out = RelayState(str(tmp_path / "s")), str(tmp_path / "json")
    rows = [("C-1", 'S-"quoted"', 0.5, NOW + HOUR), ("C-1", "S-2", 1e-7, NOW + 2 * HOUR), ("A", "", 0.0, NOW + HOUR),
            ("expired", "x", 1.0, NOW - HOUR)]
    columns = ("referencing", "referenced", "weight", "expires_at")
    edges = state.remember_edges(spark.createDataFrame(rows, list(columns)), NOW)
    export_edges(edges, out)
    assert rows_of(read_edges(spark, out), *columns) == rows_of(edges, *columns) == sorted(rows[:3])
    parts = sorted((tmp_path / "json").glob("part-*"))
    assert len(json.loads("".join(p.read_text() for p in parts))) == 3
    export_edges(edges.limit(0), str(tmp_path / "none"))
    assert read_edges(spark, str(tmp_path / "none")).count() == 0


# --- pruned stores -----------------------------------------------------------------------


def documents(spark, *rows):
    """(kind, time, digest, body) as rows to store."""
    made = [
        (k, t, d, f"{k}/{t:%Y-%m-%d-%H}/{d}", f"r/{d}", bytearray(body), f"{t:%Y-%m}") for k, t, d, body in rows
    ]
    schema = (
        "kind string, published timestamp, digest string, storage_path string, recent_path string, "
        "raw binary, month string"
    )
    return spark.createDataFrame(made, schema)


def test_only_touched_parts_are_searched_and_written(spark, tmp_path):
    archive = str(tmp_path / "a")
    day = datetime(2020, 5, 1, 3)
    rows = [("consensus", day + timedelta(days=d), f"{d}", b"old") for d in range(5)]
    rows += [("server", day, f"{d}abc", b"s") for d in "0123"]
    assert store_documents(documents(spark, *rows), archive).count() == 9

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}

    before = files()
    changed = documents(
        spark, ("consensus", day, "0", b"new"), ("consensus", day + timedelta(days=1), "1", b"old"),
        ("server", day, "1abc", b"other bytes"), ("server", day, "1abd", b"s"),
    )
    stored = store_documents(changed, archive)
    assert rows_of(stored, "kind", "digest") == [("consensus", "0"), ("server", "1abd")]
    after = files()
    touched = {p.parent.name for p in before.keys() ^ after.keys()}
    assert touched == {"part=01", "part=1"}  # one day, one digit
    assert rows_of(read_archive(spark, archive, ["consensus"]).filter("digest < '2'"), "raw") == [
        (bytearray(b"new"),), (bytearray(b"old"),)
    ]
    assert store_documents(changed, archive).count() == 0

    stored_side = touched_by(spark.read.parquet(archive), stored, PARTITIONS)
    plan = explained(spark, skip_processed(stored.select("storage_path"), stored_side, ["storage_path"]))
    scans = [s for s in plan.split("Scan parquet")[1:] if "PartitionFilters: [" in s]
    assert scans
    for scan in scans:
        filters = scan.split("PartitionFilters: ")[1].split("\n")[0]
        assert all(f"{c}#" in filters for c in PARTITIONS)
        # of the stored side only names are read
        assert "ReadSchema: struct<storage_path:string>" in scan


# --- sync by files ---------------------------------------------------------------------------


def test_an_unchanged_remote_is_not_read(spark, tmp_path):
    folder, _, _ = relay_folder(tmp_path)
    remote, local, state = (str(tmp_path / n) for n in ("remote", "local", "sync"))
    run_relays(spark, folder, remote, NOW)
    assert continue_sync(spark, remote, local, state, ["server", "vote"]).count() == 2
    assert continue_sync(spark, remote, local, state).count() == 6
    # no file of the remote can be read any more, and none is
    for path in (tmp_path / "remote").rglob("*.parquet"):
        stat = path.stat()
        path.write_bytes(b"x" * stat.st_size)
        os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert continue_sync(spark, remote, local, state).count() == 0
    assert read_archive(spark, local).count() == 8 and folder_names(spark, state)
