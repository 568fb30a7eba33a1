"""Files of logs and descriptors as DataFrames.

Plain files are read by Spark's own readers, compressed logs and archives by the data
sources of ``packed``, which stream; bz2 files of descriptors are unpacked by an Arrow
function, one file at a time.
"""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.formats import BRIDGE_AUTHORITIES, TARBALL_NAME
from descry.functions.text import as_text, file_path, once, unix_lines
from descry.operators.access_logs import HOSTS, latest_log_files, parse_log_path
from descry.operators.documents import classify, documents_in, explode_documents
from descry.operators.keys import skip_processed
from descry.sources.packed import LOG_ROWS, PACKED, ArchiveMembers, PackedLines, read_parts

#: Names given to a reader at a time.
PATHS_AT_ONCE = 10_000
BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LOG_GLOB = "*access.log*"


def list_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Path, size and time of all files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select("path", "length", "modificationTime")


def literal(path: str) -> str:
    """A path as a pattern that names this path alone."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def path_slices(files: DataFrame, at_once: int = PATHS_AT_ONCE) -> Iterator[list[str]]:
    """All different paths of ``files`` in order, so many at a time; the driver holds one slice."""
    slice_: list[str] = []
    for row in files.select("path").distinct().orderBy("path").toLocalIterator():
        slice_.append(row.path)
        if len(slice_) == at_once:
            yield slice_
            slice_ = []
    if slice_:
        yield slice_


def read_binary(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """Contents of the files in ``wanted`` (path), each opened by its name.

    However many there are, no other file is opened: names are given in slices whose
    frames are put one after the other.
    """
    parts = [binary_of(spark, paths) for paths in path_slices(wanted)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], BINARY_SCHEMA)


def binary_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Contents of the files of one slice."""
    return _binary(spark, [literal(p) for p in paths])


def _binary(spark: SparkSession, folders: str | Sequence[str]) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .load(folders)
    )


# --- access logs -----------------------------------------------------------------

def is_packed(path: str) -> bool:
    return path.endswith(PACKED)


def read_log_rows(spark: SparkSession, paths: Sequence[str], **options: int) -> DataFrame:
    """Rows (path, part, ended, seam, line) of one slice of logs, each byte unpacked once.

    Compressed logs are read by the parts they allow: an xz file of several blocks by many
    tasks.  A part that was read to its end leaves a row with the number of parts of its
    file in ``ended``; see ``sound_files`` and ``seam_lines``.  Plain logs have no such
    rows, as they can't show damage; Spark splits them itself.
    """
    packed = [p for p in paths if is_packed(p)]
    plain = [literal(p) for p in paths if not is_packed(p)]
    rows = spark.createDataFrame([], LOG_ROWS)
    if plain:
        lines = spark.read.text(plain).select(
            file_path().alias("path"), F.col("value").alias("line")
        )
        rows = rows.unionByName(lines, allowMissingColumns=True)
    if packed:
        rows = rows.unionByName(read_parts(spark, PackedLines, packed, **options))
    return rows


def sound_files(ends: DataFrame) -> DataFrame:
    """Paths of the compressed files all of whose parts were read to their end.

    A damaged file counts for nothing, not even for its first lines, and is looked at again
    in the next run.
    """
    parts = ends.groupBy("path").agg(
        F.count_distinct("part").alias("found"), F.max("ended").alias("parts")
    )
    return parts.filter("found = parts").select("path")


def seam_lines(ends: DataFrame) -> DataFrame:
    """Lines (path, line) that lie across parts of a file; a file has few seams, two ends of a
    line for each of its parts."""
    joined = ends.filter("seam IS NOT NULL").groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("part", "seam"))).alias("seams")
    )
    whole = F.array_join(F.transform("seams", lambda s: s["seam"]), "")
    lines = joined.select("path", F.explode(F.split(whole, "\n", -1)).alias("line"))
    return lines.withColumn("line", F.regexp_replace("line", "\r+\\z", "")).filter("line <> ''")


def read_access_logs(spark: SparkSession, paths: Sequence[str], **options: int) -> DataFrame:
    """Lines of the sound logs of one slice, with their path.

    Which logs are sound is known at their end only, so they are read once before; a job
    that counts lines does it in one pass, see ``plans.access_logs.stage_logs``.
    """
    rows = read_log_rows(spark, paths, **options)
    ends = rows.filter("ended IS NOT NULL").select("path", "part", "ended", "seam")
    plain = F.lit(True)
    for suffix in PACKED:
        plain &= ~F.col("path").endswith(suffix)
    sound = sound_files(ends)
    lines = rows.filter("ended IS NULL").select("path", "line")
    packed = lines.filter(~plain).unionByName(seam_lines(ends)).join(sound, "path", "left_semi")
    return lines.filter(plain).unionByName(packed)


def list_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Logs below a folder; of several for one host pair and date the largest path counts."""
    return latest_log_files(parse_log_path(list_files(spark, folder, LOG_GLOB)))


def log_slices(files: DataFrame) -> Iterator[tuple[list[str], DataFrame]]:
    """Slices of the paths of log files, each with a frame of its paths and hosts."""
    for paths in path_slices(files):
        named = files.sparkSession.createDataFrame([(p,) for p in paths], "path string")
        yield paths, parse_log_path(named).select("path", *HOSTS, "file_date")


def read_log_files(
    spark: SparkSession, folder: str, processed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Log files present, and the lines (with hosts) of those not in ``processed``."""
    files = list_logs(spark, folder)
    new = files if processed is None else skip_processed(files, processed, ["path"])
    parts = [
        read_access_logs(spark, paths).join(F.broadcast(hosts), "path")
        for paths, hosts in log_slices(new)
    ]
    empty = spark.createDataFrame([], "path string, line string").join(
        files.select("path", *HOSTS, "file_date"), "path"
    )
    return files, reduce(DataFrame.unionByName, parts) if parts else empty


# --- descriptors -------------------------------------------------------------------


def _unpack_bz2(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            error = None
            if path.endswith(".bz2"):
                try:
                    content = bz2.decompress(content)
                except (OSError, EOFError, ValueError) as e:
                    content, error = None, str(e)
            yield pd.DataFrame({"path": [path], "raw": [content], "error": [error]})


FILE_SCHEMA = "path string, length long, modificationTime timestamp"


def list_descriptor_files(
    spark: SparkSession, folder: str, history: DataFrame | None = None
) -> DataFrame:
    """Files of descriptors below a folder (path, length, modificationTime), tarballs left out.

    Files in ``history`` (path, and where it has it modificationTime) are skipped; with a
    time, a file that was written again is read again.
    """
    files = list_files(spark, folder).filter(~F.col("path").endswith(".tar.bz2"))
    if history is None:
        return files
    return skip_processed(
        files, history, [c for c in ("path", "modificationTime") if c in history.columns]
    )


def read_descriptor_files(
    spark: SparkSession,
    folder: str,
    history: DataFrame | None = None,
    at_most_errors: int = 3,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Files of descriptors below a folder (path, raw), or those ``wanted`` of them.

    Tarballs are left out, bz2 is unpacked, files in ``history`` are skipped, and
    more than ``at_most_errors`` unreadable files stop the run.
    """
    if wanted is None:
        wanted = list_descriptor_files(spark, folder, history)
    files = read_binary(spark, wanted)
    packed = F.col("path").endswith(".bz2")
    unpacked = (
        files.filter(packed)
        .select("path", "content")
        .mapInPandas(_unpack_bz2, "path string, raw binary, error string")
    )
    if unpacked.filter("error is not null").limit(at_most_errors + 1).count() > at_most_errors:
        raise OSError(f"more than {at_most_errors} unreadable files below {folder}")
    plain = files.filter(~packed).select("path", F.col("content").alias("raw"))
    return plain.unionByName(unpacked.filter("error is null").select("path", "raw"))


def read_cached_descriptors(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Documents in cache folders (path, pos, kind, raw), by file name."""
    files = _binary(spark, list(folders)).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("content").alias("raw"),
    )
    name, text = F.col("name"), as_text(F.col("raw"))
    kind = (
        F.when(name == "cached-consensus", classify(unix_lines(text)))
        .when(name == "v3-status-votes", "vote")
        .when(name.startswith("cached-descriptors"), "server")
        .when(name.startswith("cached-extrainfo"), "extra-info")
    )
    found = F.when(name == "cached-consensus", F.array(text))
    for k in ("vote", "server", "extra-info"):
        found = F.when(F.col("kind") == k, documents_in(text, k)).otherwise(found)
    return explode_documents(once(files, kind=kind), found, F.col("kind")).drop("name")


# --- bridge tarballs ------------------------------------------------------------------

def parse_tarball_name(df: DataFrame, path: str = "path") -> DataFrame:
    """Authority and time from a tarball's name; other files are dropped."""
    name = F.element_at(F.split(path, "/"), -1)
    group = lambda i: F.regexp_extract(name, TARBALL_NAME, i)
    authority = F.create_map(*[F.lit(x) for kv in BRIDGE_AUTHORITIES.items() for x in kv])
    return (
        df.withColumn("tarball", name)
        .withColumn("authority", F.try_element_at(authority, group(1)))
        .withColumn(
            "default_published",
            F.concat(
                F.concat_ws("-", group(2), group(3), group(4)),
                F.lit(" "),
                F.concat_ws(":", group(5), group(6), group(7)),
            ),
        )
        .filter(F.col("authority").isNotNull())
    )


def read_tarballs(
    spark: SparkSession, folder: str, processed: DataFrame | None = None
) -> DataFrame:
    """Members of bridge tarballs (tarball, authority, default_published, member, raw).

    A row without a member tells that its tarball was read to the end, so that
    damaged tarballs are tried again and empty ones are not.  A tarball is not
    splittable, so its members are spread over tasks right after unpacking.
    """
    wanted = parse_tarball_name(list_files(spark, folder, "*.tar*"))
    if processed is not None:
        wanted = skip_processed(wanted, processed, ["tarball"])
    parts = [
        read_parts(spark, ArchiveMembers, paths).select("path", "member", "raw")
        for paths in path_slices(wanted)
    ]
    none = spark.createDataFrame([], "path string, member string, raw binary")
    members = parse_tarball_name(reduce(DataFrame.unionByName, parts, none))
    columns = ["tarball", "authority", "default_published"]
    return members.select(*columns, "member", "raw").repartition("tarball", "member")


def read_bridge_tarballs(
    spark: SparkSession, folder: str, processed: DataFrame | None = None
) -> DataFrame:
    return read_tarballs(spark, folder, processed).filter(F.col("member").isNotNull())
