"""Compressed logs in parts, archives by members, large files in pieces, the stateful stream."""

import base64
import gzip
import hashlib
import io
import lzma
import os
import tarfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from samples import EXTRA_INFO_LINES, PUBLISHED, SERVER_LINES, edited, text
from test_logs import NOW as LOGS_NOW
from test_logs import line, stored, tables, write
from test_sources import put

from descry.plans.access_logs import run_access_logs, stage_logs
from descry.plans.index import indexed_files, run_index
from descry.sources.files import list_files, list_logs, read_access_logs, read_log_rows, sound_files
from descry.sources.packed import ArchiveMembers, FilePieces, open_file, parts_of, read_parts, xz_blocks
from descry.streaming.jobs import stream_descriptors

NOW = datetime(2018, 1, 1)


def number(value):
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def xz_of_blocks(chunks):
    """An xz stream with a block for each chunk, put together from streams of one block."""
    blocks, records, header = b"", b"", b""
    for chunk in chunks:
        stream = lzma.compress(chunk, lzma.FORMAT_XZ, check=lzma.CHECK_CRC64)
        ((start, padded, unpacked),) = xz_blocks(io.BytesIO(stream))
        header = stream[:12]
        index = stream[start + padded : -12]
        # its own record tells the size without padding
        size, at = 0, 2
        shift = 0
        while True:
            size |= (index[at] & 127) << shift
            shift += 7
            at += 1
            if not index[at - 1] & 128:
                break
        records += number(size) + number(unpacked)
        blocks += stream[start : start + padded]
    index = b"\0" + number(len(chunks)) + records
    index += b"\0" * (-len(index) % 4)
    index += zlib.crc32(index).to_bytes(4, "little")
    size = (len(index) // 4 - 1).to_bytes(4, "little") + header[6:8]
    return header + blocks + index + zlib.crc32(size).to_bytes(4, "little") + size + b"YZ"


def log_file(folder, chunks):
    path = put(folder, "h/www.example.org-access.log-20161120.xz", xz_of_blocks(chunks))
    assert lzma.decompress(path.read_bytes()) == b"".join(chunks)
    return path


CONTENT = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000)).encode() + b"no end"


@pytest.mark.parametrize("cuts", [[10], [1000, 2000, 30000], [7, 8, 9, 10], []])
def test_parts_of_a_log_make_up_its_lines(spark, tmp_path, cuts):
    places = [0, *cuts, len(CONTENT)]
    chunks = [CONTENT[a:b] for a, b in zip(places, places[1:])]
    path = str(log_file(tmp_path, chunks))
    rows = read_log_rows(spark, [path], partBytes=1).collect()
    ended = [r for r in rows if r.ended is not None]
    assert len(ended) == len(chunks) and {r.ended for r in ended} == {len(chunks)}
    lines = read_access_logs(spark, [path], partBytes=1)
    assert sorted(r.line for r in lines.collect()) == sorted(CONTENT.decode().split("\n"))


def test_an_xz_file_of_many_blocks_is_read_by_many_tasks(spark, tmp_path):
    chunks = [CONTENT[i : i + 10_000] for i in range(0, len(CONTENT), 10_000)]
    path = str(log_file(tmp_path, chunks))
    with open_file(path) as file:
        assert [b[2] for b in xz_blocks(file)] == [len(c) for c in chunks]
    parts = parts_of(path, 1)
    assert len(parts) == len(chunks) and sum(p.unpacked for p in parts) == len(CONTENT)
    assert len(parts_of(path, 1 << 20)) == 1 and len(parts_of(path, parts[0].size + 1)) < len(parts)
    assert read_log_rows(spark, [path], partBytes=1).rdd.getNumPartitions() >= len(chunks)


@pytest.mark.parametrize("place", [0.2, 0.5, 0.8])
def test_one_damaged_block_makes_a_file_unsound(spark, tmp_path, place):
    chunks = [CONTENT[i : i + 30_000] for i in range(0, len(CONTENT), 30_000)]
    path = log_file(tmp_path, chunks)
    data = bytearray(path.read_bytes())
    data[int(len(data) * place)] ^= 0xFF
    path.write_bytes(data)
    rows = read_log_rows(spark, [str(path)], partBytes=1)
    ends = rows.filter("ended IS NOT NULL")
    assert sound_files(ends).count() == 0 and ends.count() == len(chunks) - 1
    assert read_access_logs(spark, [str(path)], partBytes=1).count() == 0


def test_the_job_counts_lines_over_seams(spark, tmp_path):
    whole = "".join(line(d, f"/{i % 3}") + "\n" for d in (18, 19, 20) for i in range(400)).encode()
    chunks = [whole[i : i + 1500] for i in range(0, len(whole), 1500)]
    folder = tmp_path / "in"
    log_file(folder, chunks)
    write(folder / "other", "g", 20, [line(d) for d in (18, 19, 20)], "gz")
    t = tables(tmp_path)
    stage_logs(list_logs(spark, str(folder)), t, "job-1", partBytes=1)
    assert spark.read.parquet(t.staging).filter("line IS NULL").count() == 2
    run_access_logs(spark, str(folder), t, LOGS_NOW, limits=False)
    total = spark.read.parquet(t.archive).agg(F.sum("n")).first()[0]
    assert total == 1203 and stored(spark, t)


# --- archives and large files --------------------------------------------------------------


def tar_of(members, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


KINDS = {
    "d/servers": ("@type server-descriptor 1.0\n" + text(SERVER_LINES)).encode(),
    "d/later": ("@type server-descriptor 1.0\n" + text(edited(SERVER_LINES, "published", "published 2030-01-02 03:04:05"))).encode(),
    "d/extras": ("@type extra-info 1.0\n" + text(EXTRA_INFO_LINES)).encode(),
    "d/micro": b"@type microdescriptor 1.0\nonion-key\n",
    "d/empty": b"",
}


@pytest.mark.parametrize("suffix, mode", [("tar", "w"), ("tar.gz", "w:gz"), ("tar.xz", "w:xz"), ("tar.bz2", "w:bz2")])
def test_archives_are_indexed_by_their_members(spark, tmp_path, suffix, mode):
    data = tar_of(KINDS, mode)
    put(tmp_path, f"in/all.{suffix}", data)
    put(tmp_path, f"in/cut.{suffix}", data[: len(data) // 2])
    (row,) = run_index(spark, str(tmp_path / "in"), str(tmp_path / "s"), NOW).collect()
    assert row.types == ["extra-info 1.0", "microdescriptor 1.0", "server-descriptor 1.0"]
    assert (str(row.first_published), str(row.last_published)) == (PUBLISHED, "2030-01-02 03:04:05")
    assert row.size == len(data)
    assert row.sha256 == base64.b64encode(hashlib.sha256(data).digest()).decode()


def test_members_stream(spark, tmp_path):
    path = str(put(tmp_path, "a.tar.xz", tar_of(KINDS, "w:xz")))
    rows = read_parts(spark, ArchiveMembers, [path]).collect()
    assert {r.member: bytes(r.raw) for r in rows[:-1]} == {k: v for k, v in KINDS.items() if v}
    assert rows[-1].member is None and rows[-1].size == os.path.getsize(path)


def test_large_files_are_read_in_pieces(spark, tmp_path):
    one = KINDS["d/servers"]
    data = one * 400 + KINDS["d/later"] + KINDS["d/extras"]
    put(tmp_path, "in/large", data)
    put(tmp_path, "in/packed.gz", gzip.compress(b"x"))
    path = str(tmp_path / "in" / "large")
    pieces = read_parts(spark, FilePieces, [path], pieceBytes=50_000).filter("raw IS NOT NULL").collect()
    assert b"".join(bytes(r.raw) for r in sorted(pieces, key=lambda r: r.piece)) == data
    assert all(bytes(r.raw).startswith(b"@type ") for r in pieces)
    files = list_files(spark, str(tmp_path / "in"))
    whole = indexed_files(spark, files).orderBy("path").collect()
    cut = indexed_files(spark, files, large_file=100, pieceBytes=1000).orderBy("path").collect()
    assert whole == cut and whole[0].types == ["extra-info 1.0", "server-descriptor 1.0"]


# --- the stream of descriptors ----------------------------------------------------------------


def run_stream(spark, tmp_path, **more):
    query = stream_descriptors(
        spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp"), **more
    )
    query.awaitTermination()
    return [p for p in query.recentProgress if p["numInputRows"]]


def test_the_stream_knows_its_documents_without_the_table(spark, tmp_path):
    put(tmp_path, "in/a", text(SERVER_LINES) * 2)
    run_stream(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    # what is stored is out of sight, and the document still not new
    os.rename(tmp_path / "t", tmp_path / "away")
    put(tmp_path, "in/b", text(SERVER_LINES))
    put(tmp_path, "in/c", text(EXTRA_INFO_LINES))
    (batch,) = run_stream(spark, tmp_path)
    assert [r.kind for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["extra-info"]
    # the rows a batch reads are those of its files
    assert batch["numInputRows"] == 2
    assert batch["stateOperators"][0]["numRowsTotal"] == 2


def test_the_work_of_a_batch_does_not_grow(spark, tmp_path):
    updated = []
    for size in (1, 40):
        folder = tmp_path / str(size)
        for i in range(size):
            put(folder, f"in/{i}", text(edited(SERVER_LINES, "uptime", f"uptime {i}")))
        run_stream(spark, folder)
        put(folder, "in/new", text(EXTRA_INFO_LINES))
        (batch,) = run_stream(spark, folder)
        updated.append((batch["numInputRows"], batch["stateOperators"][0]["numRowsUpdated"]))
        assert spark.read.parquet(str(folder / "t")).count() == size + 1
    assert updated == [(1, 1), (1, 1)]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    put(tmp_path, "in/a", text(SERVER_LINES))
    run_stream(spark, tmp_path)
    # the commit of the last batch is lost: it runs again
    for commit in sorted((tmp_path / "cp" / "commits").iterdir()):
        commit.unlink()
    run_stream(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
