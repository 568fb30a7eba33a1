"""Access-log files end to end: codecs, safe days, order and repetition of runs."""

import bz2
import gzip
import lzma
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from descry.operators.access_logs import parse_access_log, sanitize_access_log
from descry.plans.access_logs import ARCHIVE_SCHEMA, LogTables, run_access_logs
from descry.sinks.files import write_log_archive
from descry.sources.files import (
    list_files,
    path_slices,
    read_access_logs,
    read_binary,
    read_log_files,
)
from descry.sources.state import read_table
from descry.streaming.jobs import stream_and_store_access_logs

NOW = datetime(2016, 11, 25)


def line(day, path="/a", ip="1.2.3.4", method="GET", status=200, size="5", clock="12:00:00 +0000"):
    return f'{ip} - - [{day:02d}/Nov/2016:{clock}] "{method} {path} HTTP/1.1" {status} {size} "-" "x"'


def write(folder, host, day, lines, kind="gz"):
    target = folder / host
    target.mkdir(parents=True, exist_ok=True)
    data = ("\n".join(lines) + "\n").encode()
    pack = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "txt": bytes}[kind]
    (target / f"www.example.org-access.log-201611{day:02d}.{kind}").write_bytes(pack(data))


def tables(folder):
    return LogTables(str(folder / "staging"), str(folder / "archive"), str(folder / "state"))


def stored(spark, t):
    df = read_table(spark, t.archive, ARCHIVE_SCHEMA)
    rows = df.select(F.dayofmonth("log_date").alias("d"), "line", "n").collect()
    counts = Counter()
    for r in rows:
        counts[(r.d, r.line)] += r.n
    return counts


def sanitized(day, path="/a", size="5"):
    return f'0.0.0.0 - - [{day:02d}/Nov/2016:00:00:00 +0000] "GET {path} HTTP/1.1" 200 {size}'


@pytest.fixture
def files(tmp_path):
    """Four files covering five days, each in another codec."""
    parts = {
        20: ([line(19), line(20), line(20, "/b?secret=1")], "gz"),
        21: ([line(20), line(21)], "bz2"),
        22: ([line(21), line(22), line(21, status=404)], "xz"),
        23: ([line(22), line(23), line(21, clock="23:30:00 -0200")], "txt"),
    }

    def put(*days):
        for day in days:
            write(tmp_path / "in", "host1", day, *parts[day])
        return str(tmp_path / "in")

    return put


EXPECTED = {
    (20, sanitized(20)): 2,
    (20, sanitized(20, "/b")): 1,
    (21, sanitized(21)): 2,
}


def test_all_files_at_once(spark, tmp_path, files):
    t = tables(tmp_path)
    run_access_logs(spark, files(20, 21, 22, 23), t, NOW)
    assert stored(spark, t) == EXPECTED


@pytest.mark.parametrize("order", [(20, 21, 22, 23), (23, 22, 21, 20), (22, 20, 23, 21)])
def test_files_one_after_another(spark, tmp_path, files, order):
    t = tables(tmp_path)
    for i, day in enumerate(order):
        run_access_logs(spark, files(day), t, NOW.replace(hour=i))
    result = stored(spark, t)
    # a day is stored once, when it first is safe; what comes later is ignored
    assert set(result) <= set(EXPECTED)
    assert all(result[k] <= EXPECTED[k] for k in result)
    assert {d for d, _ in result} == {20, 21}
    if order == (20, 21, 22, 23):
        assert result == EXPECTED


def test_second_run_changes_nothing(spark, tmp_path, files):
    t = tables(tmp_path)
    folder = files(20, 21, 22, 23)
    run_access_logs(spark, folder, t, NOW)
    before = stored(spark, t)
    assert run_access_logs(spark, folder, t, NOW.replace(hour=5)).count() == 0
    assert stored(spark, t) == before


def test_without_limits_all_days_are_stored(spark, tmp_path, files):
    t = tables(tmp_path)
    run_access_logs(spark, files(20, 21, 22, 23), t, NOW, limits=False)
    assert {d for d, _ in stored(spark, t)} == {19, 20, 21, 22, 23}


@pytest.mark.parametrize("at_once", [1, 1000])
def test_stream(spark, tmp_path, files, at_once):
    t = tables(tmp_path)
    for hour, days in enumerate(((20, 21), (22, 23), ())):
        stream_and_store_access_logs(
            spark, files(*days), t, str(tmp_path / "cp"), NOW.replace(hour=hour), True, at_once
        )
    assert stored(spark, t) == EXPECTED


@pytest.mark.parametrize("at_once", [1, 1000])
def test_batches_of_one_stream_decide_together(spark, tmp_path, at_once):
    for day in (20, 21):
        write(tmp_path / "in", "h", day, [line(d) for d in range(18, 23)])
    job, stream = tables(tmp_path / "a"), tables(tmp_path / "b")
    run_access_logs(spark, str(tmp_path / "in"), job, NOW)
    stream_and_store_access_logs(
        spark, str(tmp_path / "in"), stream, str(tmp_path / "cp"), NOW, True, at_once
    )
    assert stored(spark, job) == stored(spark, stream)
    assert set(stored(spark, job).values()) == {2}


def test_days_are_stored_whatever_their_age(spark, tmp_path, files):
    t = tables(tmp_path)
    run_access_logs(spark, files(20, 21, 22, 23), t, NOW.replace(year=NOW.year + 1))
    assert stored(spark, t) == EXPECTED


@pytest.mark.parametrize("kind", ["xz", "gz", "bz2"])
def test_a_damaged_log_counts_for_nothing_until_it_is_whole(spark, tmp_path, kind):
    t, folder = tables(tmp_path), tmp_path / "in"
    write(folder, "h", 20, [line(d, f"/{i}") for d in (18, 19, 20) for i in range(3000)], kind)
    (path,) = (p for p in folder.rglob("*access.log*"))
    whole = path.read_bytes()
    path.write_bytes(whole[: len(whole) * 2 // 3])
    assert run_access_logs(spark, str(folder), t, NOW, limits=False).count() == 0
    path.write_bytes(whole)
    again = run_access_logs(spark, str(folder), t, NOW.replace(hour=3), limits=False)
    assert again.agg({"n": "sum"}).first()[0] == 9000


def test_files_are_opened_by_name_in_slices(spark, tmp_path):
    for i in range(5):
        put_at = tmp_path / "in" / f"a[{i}]{{x}}"
        put_at.mkdir(parents=True)
        (put_at / "f*?").write_bytes(b"%d" % i)
    listed = list_files(spark, str(tmp_path / "in"))
    assert [len(s) for s in path_slices(listed, 2)] == [2, 2, 1]
    wanted = listed.filter("path NOT LIKE '%a[4]%'")
    assert sorted(bytes(r.content) for r in read_binary(spark, wanted).collect()) == [
        b"0", b"1", b"2", b"3",
    ]


def test_latest_file_of_a_date_and_broken_files(spark, tmp_path, files):
    folder = files(20, 21)
    write(tmp_path / "in" / "later", "host1", 20, [line(18)])
    (tmp_path / "in" / "host1" / "www.example.org-access.log-20161130.xz").write_bytes(b"broken")
    (tmp_path / "in" / "host1" / "www.example.org-access.log-20161131.gz").write_bytes(b"bad date")
    (tmp_path / "in" / "host1" / "other.txt").write_text("no log")
    chosen, lines = read_log_files(spark, folder)
    names = sorted(r.path.split("/in/")[1] for r in chosen.collect())
    assert names == [
        "host1/www.example.org-access.log-20161121.bz2",
        "host1/www.example.org-access.log-20161130.xz",
        "later/host1/www.example.org-access.log-20161120.gz",
    ]
    assert lines.count() == 3


def test_odd_names_lose_no_lines(spark, tmp_path):
    for host in ("a b", "p%20q", "x+y", "ü"):
        for kind in ("gz", "xz", "txt"):
            write(tmp_path / kind, host, 20, [line(20), line(20)], kind)
    _, lines = read_log_files(spark, str(tmp_path))
    counts = {r.physical_host: r["count"] for r in lines.groupBy("physical_host").count().collect()}
    # per host the largest path counts: xz
    assert counts == dict.fromkeys(("a b", "p%20q", "x+y", "ü"), 2)
    for kind in ("gz", "xz", "txt"):
        _, lines = read_log_files(spark, str(tmp_path / kind))
        assert lines.count() == 8


def test_long_xz_files_are_streamed_in_batches(spark, tmp_path):
    write(tmp_path, "h", 1, [line(1, f"/{i}") for i in range(120_000)], "xz")
    (path,) = tmp_path.rglob("*.xz")
    assert read_access_logs(spark, [str(path)]).distinct().count() == 120_000


def test_lines(spark):
    cases = [
        (line(1, "?q"), "?q"),  # a leading question mark stays
        (line(1, "/x?a?b"), "/x"),
        (line(1, "/x y\x01z"), "/x y\x01z"),
        (line(1, method="POST"), None),
        (line(1, status=400), None),
        (line(1, method="GETX"), None),
        (line(1, size="99999999999"), None),
        (line(1, clock="25:00:00 +0000"), None),
        ("\x01" + line(1), None),
        ("\x01a\x01b\x01c\x01d\x01e\x01f\x01g", None),
        ("", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, line string")
    got = {r.i: r.request for r in sanitize_access_log(parse_access_log(df)).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases) if c[1] is not None}


def test_log_archive_text(spark, tmp_path):
    rows = [("v", "p", datetime(2016, 11, 20).date(), f"line {i}", 3 if i else 5) for i in range(4)]
    counts = spark.createDataFrame(
        rows, "virtual_host string, physical_host string, log_date date, line string, n bigint"
    )
    write_log_archive(counts, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert {r.storage_path for r in back.select("storage_path").distinct().collect()} == {
        "webstats/v/2016/11/20/v_p_access.log_20161120"
    }
    text = [r.value for r in back.collect()]
    assert Counter(text) == {"line 0": 5, "line 1": 3, "line 2": 3, "line 3": 3}
