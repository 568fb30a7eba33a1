"""Jobs for pools, exit lists, timings, analyses and statistics, each over two runs."""

import hashlib
import json
import lzma
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from test_sources import put

from descry.plans.listings import (
    ANALYSES,
    DISTRIBUTOR_METRICS,
    EXIT_LISTS,
    NOTHING,
    POOL_ASSIGNMENTS,
    PROXY_STATISTICS,
    TIMINGS,
    drop_recent,
    run_listing,
)
from descry.sources.state import folder_names, read_archive

NOW = datetime(2024, 3, 5, 12, 0)


class Runs:
    """Runs of one job over one folder."""

    def __init__(self, spark, root, listing, recent=False):
        self.spark, self.root, self.listing = spark, root, listing
        self.recent = f"{root}/recent" if recent else None

    def put(self, name, content):
        return put(self.root, f"in/{name}", content)

    def run(self, now=NOW):
        root = self.root
        (root / "in").mkdir(exist_ok=True)
        return run_listing(
            self.spark, self.listing, f"{root}/in", f"{root}/archive", f"{root}/state", now, self.recent
        )

    def stored(self):
        rows = read_archive(self.spark, f"{self.root}/archive").collect()
        return {r.storage_path: bytes(r.raw).decode("latin-1") for r in rows}


def written(run):
    return sorted(r.storage_path for r in run.written.collect())


def rejected(run):
    return sorted((r.path.rsplit("/", 1)[1], r.reason) for r in run.rejects.collect())


def test_pool_assignments(spark, tmp_path):
    runs = Runs(spark, tmp_path, POOL_ASSIGNMENTS)
    a, b = "aa" * 20, "bb" * 20
    head = "bridge-pool-assignment 2024-03-05 {}:00:00\n"
    runs.put("assignments.log", f"{head.format('09')}{a} email\n{b} https ring=1\n{a.upper()} moat\n")
    runs.put("assignments.log.1", f"{head.format('09')}{b} other\n{head.format('10')}{'xy' * 20} moat\n")
    runs.put("assignments.log.2", "no header\n")
    first = runs.run()
    digest = lambda f: hashlib.sha1(bytes.fromhex(f)).hexdigest()
    lines = sorted([f"{digest(a)} email", f"{digest(b)} https ring=1"])
    path = "bridge-pool-assignments/2024/03/05/2024-03-05-09-00-00"
    # the first file of a time wins; of two spellings the greater one counts
    assert runs.stored() == {
        path: "@type bridge-pool-assignment 1.0\n" + head.format("09") + "\n".join(lines) + "\n"
    }
    assert rejected(first) == [
        ("assignments.log.1", "fingerprint is no hex"),
        ("assignments.log.2", NOTHING),
    ]
    assert [(r.latest, r.stale) for r in first.freshness.collect()] == [(datetime(2024, 3, 5, 9), False)]
    runs.put("assignments.log.3", f"{head.format('11')}{a} moat\n{head.format('09')}{a} changed\n")
    second = runs.run()
    assert written(second) == ["bridge-pool-assignments/2024/03/05/2024-03-05-11-00-00"]
    assert rejected(second) == [] and "email" in runs.stored()[path]
    assert written(runs.run()) == []


EXIT_LIST = (
    "ExitNode {n}\nPublished 2024-03-05 01:00:00\nLastStatus 2024-03-05 02:00:00\n"
    "ExitAddress 10.0.0.1 2024-03-05 03:0{i}:00\n"
)


def test_exit_lists(spark, tmp_path):
    runs = Runs(spark, tmp_path, EXIT_LISTS, recent=True)
    head = "@type tordnsel 1.0\nDownloaded 2024-03-05 0{}:02:00\n"
    one = head.format(4) + EXIT_LIST.format(n="A", i=1) + EXIT_LIST.format(n="B", i=2)
    runs.put("one", one)
    runs.put("two", head.format(5) + head.format(6) + EXIT_LIST.format(n="A", i=1))
    runs.put("three", EXIT_LIST.format(n="A", i=1) + "other\n")
    first = runs.run()
    assert runs.stored() == {"exit-lists/2024/03/05/2024-03-05-04-02-00": one}
    assert rejected(first) == [("three", "not one exit list"), ("two", "not one exit list")]
    # the last scan, not the download, tells how late the list is
    found = first.freshness.first()
    assert (found.latest, found.stale) == (datetime(2024, 3, 5, 3, 2), True)
    recent = list(Path(tmp_path, "recent", "arrived=2024-03-05").rglob("part-*"))
    assert [p.read_text() for p in recent] == [one]
    # a later list of one time replaces the earlier; a plain list gets the time it arrived
    runs.put("zero", head.format(4) + EXIT_LIST.format(n="C", i=3))
    runs.put("plain", EXIT_LIST.format(n="D", i=4))
    second = runs.run(NOW + timedelta(days=1))
    assert len(written(second)) == 2 and rejected(second) == []
    texts = runs.stored()
    assert "ExitNode C" in texts["exit-lists/2024/03/05/2024-03-05-04-02-00"] and len(texts) == 2
    plain = next(t for t in texts.values() if "ExitNode D" in t)
    assert plain.startswith("@type tordnsel 1.0\nDownloaded 20")
    days = ["arrived=2024-03-05", "arrived=2024-03-06"]
    assert sorted(folder_names(spark, f"{tmp_path}/recent")) == days
    assert drop_recent(spark, f"{tmp_path}/recent", NOW + timedelta(days=4)) == days[:1]
    assert folder_names(spark, f"{tmp_path}/recent") == days[1:]


def test_timings(spark, tmp_path):
    runs = Runs(spark, tmp_path, TIMINGS)
    row = "@type torperf 1.1\nSOURCE={} FILESIZE={} START=1709600400.25 DIDTIMEOUT=0\n"
    good = row.format("op-nl", 51200) * 2
    runs.put("op-nl-51200-2024-03-05.tpf", good)
    runs.put("op-us-51200-2024-03-05.tpf", good)
    runs.put("op-nl-1048576-2024-03-05.tpf", good)
    runs.put("op-nl-51200-2024-03-06.tpf", good)
    runs.put("op-nl-51200-2024-13-06.tpf", good)
    runs.put("op-nl-1-2024-03-05.tpf", row.format("op-nl", 1) + "router x\n")
    runs.put("op-nl-2-2024-03-05.tpf", "@type torperf 1.1\n")
    first = runs.run()
    path = "torperf/2024/03/05/op-nl-51200-2024-03-05.tpf"
    assert runs.stored() == {path: good}
    assert rejected(first) == [
        ("op-nl-1-2024-03-05.tpf", "other than timings"),
        ("op-nl-1048576-2024-03-05.tpf", "differs from file name"),
        ("op-nl-2-2024-03-05.tpf", "no timings"),
        ("op-nl-51200-2024-03-06.tpf", "differs from file name"),
        ("op-nl-51200-2024-13-06.tpf", "invalid file name"),
        ("op-us-51200-2024-03-05.tpf", "differs from file name"),
    ]
    assert first.freshness.count() == 0
    runs.put("op-nl-2-2024-03-05.tpf", row.format("op-nl", 2))
    again = runs.put("again/op-nl-51200-2024-03-05.tpf", good * 2)
    second = runs.run()
    assert written(second) == ["torperf/2024/03/05/op-nl-2-2024-03-05.tpf", path]
    assert runs.stored()[path] == good * 2 and again.exists()
    assert written(runs.run()) == []


def test_analyses(spark, tmp_path):
    def document(*sources, transfers=None):
        one = {"t1": {"filesize_bytes": 5, "unix_ts_start": 1709600400.5}}
        data = {s: {"tgen": {"transfers": one if transfers is None else transfers}} for s in sources}
        return lzma.compress(json.dumps({"type": "x", "data": data}).encode())

    runs = Runs(spark, tmp_path, ANALYSES, recent=True)
    good = document("op-nl")
    runs.put("op-nl/2024-03-05.onionperf.analysis.json.xz", good)
    runs.put("x/2024-03-05.op-us.onionperf.analysis.json.xz", document("op-us", "op-nl"))
    runs.put("x/2024-03-06.op-us.onionperf.analysis.json.xz", b"broken")
    runs.put("x/2024-03-07.op-us.onionperf.analysis.json.xz", good[:-5])
    runs.put("x/2024-03-08.op-us.onionperf.analysis.json.xz", lzma.compress(b"{no json"))
    runs.put("x/2024-03-09.op-us.onionperf.analysis.json.xz", document("op-us", "y", transfers={}))
    runs.put("x/2024-3-9.op-us.onionperf.analysis.json.xz", document("op-us"))
    first = runs.run()
    own = "onionperf/2024/03/05/2024-03-05.op-nl.onionperf.analysis.json.xz"
    assert runs.stored()[own].encode("latin-1") == good
    assert written(first) == [own, "onionperf/2024/03/09/2024-03-09.op-us.onionperf.analysis.json.xz"]
    assert rejected(first) == [
        ("2024-03-05.op-us.onionperf.analysis.json.xz", "transfer of another source"),
        ("2024-03-06.op-us.onionperf.analysis.json.xz", "unreadable"),
        ("2024-03-07.op-us.onionperf.analysis.json.xz", "unreadable"),
        ("2024-03-08.op-us.onionperf.analysis.json.xz", "no analysis"),
        ("2024-3-9.op-us.onionperf.analysis.json.xz", "invalid file name"),
    ]
    assert folder_names(spark, f"{tmp_path}/recent") == []
    runs.put("x/2024-03-06.op-us.onionperf.analysis.json.xz", document("op-us"))
    second = runs.run()
    assert written(second) == ["onionperf/2024/03/06/2024-03-06.op-us.onionperf.analysis.json.xz"]
    assert rejected(second) == []


@pytest.mark.parametrize(
    "listing, end, path",
    [
        (PROXY_STATISTICS, "snowflake-stats-end", "snowflakes/2024/03/0{0}/2024-03-0{0}-00-00-00-snowflake-stats"),
        (
            DISTRIBUTOR_METRICS,
            "bridgedb-metrics-end",
            "bridgedb-metrics/2024/03/0{0}/2024-03-0{0}-00-00-00-bridgedb-metrics",
        ),
    ],
)
def test_statistics(spark, tmp_path, listing, end, path):
    runs = Runs(spark, tmp_path, listing)
    document = f"{end} 2024-03-0{{}} 00:00:00 (86400 s)\nx {{}}\n"
    annotation = f"@type {end.removesuffix('-end')} 1.0\n"
    runs.put("a", annotation + document.format(1, 1) + annotation + document.format(2, 1))
    runs.put("b", "router x\n" + document.format(2, 2))
    runs.put("c", "\n")
    runs.put("empty", "")
    first = runs.run(datetime(2024, 3, 4, 1))
    assert runs.stored() == {path.format(i): annotation + document.format(i, 1) for i in (1, 2)}
    assert rejected(first) == [("b", "no statistics"), ("c", NOTHING)]
    late = [(r.latest.day, r.stale) for r in first.freshness.collect()]
    assert late == ([(2, True)] if listing is PROXY_STATISTICS else [])
    runs.put("d", document.format(3, 3) + document.format(1, 9))
    # an empty file is not read, and so it is read once it has content
    runs.put("empty", document.format(4, 4))
    assert written(runs.run()) == [path.format(3), path.format(4)]
    assert runs.stored()[path.format(1)].endswith("x 1\n")


def test_no_files(spark, tmp_path):
    run = Runs(spark, tmp_path, TIMINGS).run()
    assert (written(run), rejected(run), run.freshness.count()) == ([], [], 0)
