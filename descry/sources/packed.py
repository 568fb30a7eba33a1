"""Compressed logs, archives and large files, read in parts.

Three data sources plan one partition for each file, or for some blocks of an xz file, and
stream through it: no row holds a file.  Each part that was read to its end leaves a row
that says so, so a damaged file is told in the same pass that reads it.

Files are opened where tasks run, by local path or through any file system that Arrow knows.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import json
import lzma
import re
import tarfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes unpacked at once, lines in a batch, and packed bytes of the blocks of one part.
CHUNK, LINES_PER_BATCH, PART_BYTES = 1 << 20, 50_000, 8 << 20
#: Size of the pieces that a large file is cut into, before a line that starts a document.
PIECE_BYTES = 32 << 20
DAMAGE = (lzma.LZMAError, EOFError, OSError, zlib.error, ValueError, tarfile.TarError)
PACKED = (".xz", ".gz", ".bz2")
ARCHIVES = (".tar", ".tar.gz", ".tgz", ".tar.xz", ".tar.bz2")
#: A line that parses as any other, in rows that tell of the end of a part.
END_LINE = '0.0.0.0 - - [01/Jan/1970:00:00:00 +0000] "GET / HTTP/1.0" 200 0'
LOG_ROWS = "path string, part int, ended int, seam string, line string"
MEMBER_ROWS = "path string, member string, raw binary, size long, sha256 string"
PIECE_ROWS = "path string, piece int, raw binary, size long, sha256 string"


def open_file(path: str) -> BinaryIO:
    """A file for reading from any place in it; paths as Spark lists them."""
    local = re.sub(r"\Afile:/*", "/", path)
    if local.startswith("/"):
        return open(local, "rb")
    scheme, rest = path.split(":", 1)
    system, inside = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
    return system.open_input_file(inside)


# --- blocks of xz files ---------------------------------------------------------------------


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of 7 bits a byte, the least first, and the place after it."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            return value, at


def xz_blocks(file: BinaryIO) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of the blocks of an xz file of one stream; none
    where the file has another form or is damaged."""
    try:
        length = file.seek(0, 2)
        file.seek(length - 12)
        footer = file.read(12)
        if footer[-2:] != b"YZ":
            return []
        index_size = (int.from_bytes(footer[4:8], "little") + 1) * 4
        file.seek(length - 12 - index_size)
        index = file.read(index_size)
        if index[:1] != b"\0" or zlib.crc32(index[:-4]) != int.from_bytes(index[-4:], "little"):
            return []
        count, at = _number(index, 1)
        blocks, start = [], 12
        for _ in range(count):
            size, at = _number(index, at)
            unpacked, at = _number(index, at)
            padded = (size + 3) // 4 * 4
            blocks.append((start, padded, unpacked))
            start += padded
        return blocks if start + index_size + 12 == length else []
    except (*DAMAGE, IndexError):
        return []


@dataclass
class Part(InputPartition):
    """A file, or some neighbouring blocks of one."""

    path: str
    number: int = 0
    of: int = 1
    start: int = 0
    size: int = 0
    unpacked: int = 0

    def __hash__(self) -> int:
        return hash((self.path, self.number))


def parts_of(path: str, part_bytes: int) -> list[Part]:
    """A file whole, or an xz file cut into parts of at least ``part_bytes``."""
    if not path.endswith(".xz"):
        return [Part(path)]
    try:
        with open_file(path) as file:
            blocks = xz_blocks(file)
    except OSError:
        return [Part(path)]
    groups: list[list[tuple[int, int, int]]] = []
    for block in blocks:
        if not groups or sum(b[1] for b in groups[-1]) >= part_bytes:
            groups.append([])
        groups[-1].append(block)
    if len(groups) < 2:
        return [Part(path)]
    return [
        Part(path, k, len(groups), g[0][0], sum(b[1] for b in g), sum(b[2] for b in g))
        for k, g in enumerate(groups)
    ]


def _unpacked_blocks(file: BinaryIO, part: Part) -> Iterator[bytes]:
    """Content of a part's blocks, each verified by its own checksum."""
    decoder = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    decoder.decompress(file.read(12))  # the stream's header says how blocks are checked
    file.seek(part.start)
    left, found = part.size, 0
    while left:
        data = file.read(min(left, CHUNK))
        if not data:
            raise EOFError
        left -= len(data)
        out = decoder.decompress(data)
        found += len(out)
        yield out
    if found != part.unpacked:
        raise EOFError


def unpacked(part: Part) -> Iterator[bytes]:
    """Content of a part, in chunks; raises one of DAMAGE where it cannot be read."""
    with open_file(part.path) as file:
        if part.of > 1:
            yield from _unpacked_blocks(file, part)
            return
        name = part.path
        if name.endswith(".gz"):
            file = gzip.GzipFile(fileobj=file)
        elif name.endswith(".bz2"):
            file = bz2.BZ2File(file)
        elif name.endswith(".xz"):
            file = lzma.LZMAFile(file)
        while chunk := file.read(CHUNK):
            yield chunk


# --- lines of logs -----------------------------------------------------------------------------


class _OfPaths(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.part_bytes = int(options.get("partBytes") or PART_BYTES)
        self.piece_bytes = int(options.get("pieceBytes") or PIECE_BYTES)

    def partitions(self) -> Sequence[InputPartition]:
        return [Part(p) for p in self.paths]


def _text(line: bytes) -> str:
    return line.decode("utf-8", "replace").rstrip("\r")


class _LineReader(_OfPaths):
    def partitions(self) -> Sequence[InputPartition]:
        return [part for path in self.paths for part in parts_of(path, self.part_bytes)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """Whole lines of a part, then, if it was read to its end, a row that says so.

        The last row of one part of several carries its seam: what stands before its first
        line end, which ends a line of the part before, and what stands after its last.
        """
        head: bytes | None = None if partition.number else b""
        lines: list[bytes] = []
        pieces: list[bytes] = []
        try:
            for chunk in unpacked(partition):
                if b"\n" not in chunk:
                    pieces.append(chunk)
                    continue
                whole = (b"".join(pieces) + chunk).split(b"\n")
                pieces = [whole.pop()]
                if head is None:
                    head = whole.pop(0)
                lines += whole
                while len(lines) >= LINES_PER_BATCH:
                    yield self._batch(partition, lines[:LINES_PER_BATCH])
                    lines = lines[LINES_PER_BATCH:]
        except DAMAGE:
            return
        rest = b"".join(pieces)
        seam = None
        if partition.of == 1:
            lines += [rest] if rest else []
        elif partition.number == 0:
            seam = rest
        else:
            seam = rest if head is None else head + b"\n" + rest
        if lines:
            yield self._batch(partition, lines)
        end = {
            "path": [partition.path], "part": [partition.number], "ended": [partition.of],
            "seam": [None if seam is None else seam.decode("utf-8", "replace")], "line": [END_LINE],
        }
        yield pa.RecordBatch.from_pydict(end, _LOG_SCHEMA)

    def _batch(self, part: Part, lines: list[bytes]) -> pa.RecordBatch:
        nothing = pa.nulls(len(lines), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part.path] * len(lines)), nothing, nothing,
                pa.nulls(len(lines), pa.string()), pa.array([_text(line) for line in lines], pa.string()),
            ],
            schema=_LOG_SCHEMA,
        )


_LOG_SCHEMA = pa.schema(
    [("path", pa.string()), ("part", pa.int32()), ("ended", pa.int32()), ("seam", pa.string()),
     ("line", pa.string())]
)


class PackedLines(DataSource):
    """Lines of the files named by the option ``paths``, a JSON array."""

    @classmethod
    def name(cls) -> str:
        return "packed_lines"

    def schema(self) -> str:
        return LOG_ROWS

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


# --- members of archives, pieces of files ----------------------------------------------------------


class _Hashing:
    """A file that hashes and counts what is read of it."""

    def __init__(self, file: BinaryIO):
        self.file, self.size, self.digest = file, 0, hashlib.sha256()

    def read(self, size: int = -1) -> bytes:
        data = self.file.read(size)
        self.size += len(data)
        self.digest.update(data)
        return data

    def drain(self) -> None:
        while self.read(CHUNK):
            pass


class _MemberReader(_OfPaths):
    def read(self, partition: Part) -> Iterator[tuple]:
        """Members with their bytes; then, of an archive read to its end, its size and digest."""
        path = partition.path
        try:
            with open_file(path) as raw:
                hashing = _Hashing(raw)
                with tarfile.open(fileobj=hashing, mode="r|*") as tar:
                    for member in tar:
                        data = tar.extractfile(member).read() if member.isfile() else b""
                        if data:
                            yield path, member.name, data, None, None
                hashing.drain()
        except DAMAGE:
            # the members before the damage stay; the archive is not finished
            return
        yield path, None, None, hashing.size, hashing.digest.hexdigest()


class ArchiveMembers(DataSource):
    """Members of the tar archives named by the option ``paths``, plain or compressed."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBER_ROWS

    def reader(self, schema) -> DataSourceReader:
        return _MemberReader(self.options)


class _PieceReader(_OfPaths):
    def read(self, partition: Part) -> Iterator[tuple]:
        """Pieces that start where a document does; then the file's size and digest."""
        path, piece, held = partition.path, 0, bytearray()
        try:
            with open_file(path) as raw:
                hashing = _Hashing(raw)
                while chunk := hashing.read(CHUNK):
                    held += chunk
                    cut = held.rfind(b"\n@type ") + 1 if len(held) >= self.piece_bytes else 0
                    if cut:
                        yield path, piece, bytes(held[:cut]), None, None
                        piece, held = piece + 1, held[cut:]
        except DAMAGE:
            return
        yield path, piece, bytes(held), None, None
        yield path, None, None, hashing.size, hashing.digest.hexdigest()


class FilePieces(DataSource):
    """Pieces of the files named by the option ``paths``."""

    @classmethod
    def name(cls) -> str:
        return "file_pieces"

    def schema(self) -> str:
        return PIECE_ROWS

    def reader(self, schema) -> DataSourceReader:
        return _PieceReader(self.options)


def read_parts(
    spark: SparkSession, source: type[DataSource], paths: Sequence[str], **options: int
) -> DataFrame:
    """Rows of one of the sources over one slice of paths."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("paths", json.dumps(list(paths)))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
