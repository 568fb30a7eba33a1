"""Lists, timings and statistics: one text per file, rows per entry."""

from __future__ import annotations

import io
import lzma
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.formats import (
    ANALYSIS_NAME,
    ANNOTATIONS,
    DISTRIBUTOR_METRICS_END,
    EXIT_LIST_LINES,
    POOL_HEADER,
    PROXY_STATS_END,
    TPF_NAME,
)
from descry.functions.text import (
    file_path,
    last_per_key,
    let,
    lines_of,
    once,
    parse_time,
    sections,
    unix_lines,
)
from descry.functions.times import at


def _texts(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(folder, wholetext=True).select(
        file_path().alias("path"), unix_lines(F.col("value")).alias("text")
    )


# --- pool assignments ---------------------------------------------------------------

def parse_pool_assignments(texts: DataFrame) -> DataFrame:
    """Assignments (path, published, fingerprint, details) of files of groups.

    A header line starts a group.  Reading a file stops at its first malformed
    line, keeping what came before.  A repeated header discards the earlier
    group, a repeated fingerprint the earlier line.
    """

    def group(part: Column) -> Column:
        return let(lines_of(part), grouped)

    def grouped(lines: Column) -> Column:
        time = parse_time(F.substr(lines[0], F.lit(len(POOL_HEADER) + 1)))
        body = F.slice(lines, 2, F.size(lines))
        bad = F.transform(body, lambda x: ~x.rlike(r"\A[^ ]{40,} "))
        bad_at = F.array_position(bad, True).cast("int")
        read = F.when(bad_at > 0, F.slice(body, 1, F.greatest(bad_at - 1, F.lit(0)))).otherwise(body)
        return F.struct(
            time.alias("published"), (time.isNull() | (bad_at > 0)).alias("bad"), read.alias("lines")
        )

    def before_first_bad(groups: Column) -> Column:
        bad = F.array_position(F.transform(groups, lambda g: g["bad"]), True).cast("int")
        return F.when(bad == 0, groups).otherwise(F.slice(groups, 1, bad))

    def numbered(g: Column, i: Column) -> Column:
        return F.struct(g["published"].alias("published"), i.alias("i"), g["lines"].alias("lines"))

    def assignment(line: Column, i: Column) -> Column:
        return F.struct(
            F.substring_index(line, " ", 1).alias("fingerprint"),
            i.alias("i"),
            F.regexp_extract(line, r"\A[^ ]+ (.*)\z", 1).alias("details"),
        )

    # a line before any header stops the file at once
    parts = once(texts, __parts=sections(F.col("text"), POOL_HEADER)).filter(
        F.col("__parts")[0] == "\n"
    )
    read = let(F.transform(F.slice("__parts", 2, F.size("__parts")), group), before_first_bad)
    usable = F.filter(F.transform(read, numbered), lambda g: g["published"].isNotNull())
    lines = last_per_key(F.transform("__g.lines", assignment), "fingerprint")
    return (
        parts.select("path", F.explode_outer(last_per_key(usable, "published")).alias("__g"))
        .select("path", "__g.published", F.explode_outer(lines).alias("__a"))
        .filter(F.col("__a").isNotNull())
        .select("path", "published", "__a.fingerprint", "__a.details")
    )


def read_pool_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return parse_pool_assignments(_texts(spark, folder, "assignments.log*"))


# --- exit lists -----------------------------------------------------------------------


def annotated_exit_list(text: Column, downloaded: Column) -> Column:
    """A list with its annotation and the time it was downloaded, if it carries none."""
    time = F.date_format(downloaded, "yyyy-MM-dd HH:mm:ss")
    head = F.concat(F.lit(f"@type {ANNOTATIONS['exit-list']}\nDownloaded "), time, F.lit("\n"))
    return F.when(text.startswith("@"), text).otherwise(F.concat(head, text))


def is_exit_list(text: Column) -> Column:
    """Whether a text is exactly one list and nothing else."""
    return (
        (F.size(F.regexp_extract_all(text, F.lit(r"(?dm)^(Downloaded )"), F.lit(1))) == 1)
        & text.startswith(f"@type {ANNOTATIONS['exit-list']}\nDownloaded ")
        & ~F.exists(lines_of(text), lambda x: ~x.rlike(EXIT_LIST_LINES))
    )


def download_time(text: Column) -> Column:
    return parse_time(F.regexp_extract(text, r"(?dm)^Downloaded (.*)$", 1))


def scan_times(text: Column) -> Column:
    """Times of all scans in a list."""
    found = F.regexp_extract_all(text, F.lit(r"(?dm)^ExitAddress \S+ (.*)$"), F.lit(1))
    return F.transform(found, lambda x: parse_time(x))


def parse_exit_lists(texts: DataFrame, downloaded: datetime | None = None) -> DataFrame:
    """Exit addresses (path, downloaded, node, published, last_status, address, scan_ts).

    A list without annotation gets one, with ``downloaded`` as its time.  Only
    texts that are exactly one list and nothing else count.
    """
    if downloaded is not None:
        texts = texts.withColumn("text", annotated_exit_list(F.col("text"), at(downloaded)))
    text = F.col("text")

    def value(keyword: str) -> Column:
        return parse_time(F.regexp_extract("__node", rf"(?dm)^{keyword} (.*)$", 1))

    address = F.regexp_extract_all("__node", F.lit(r"(?dm)^ExitAddress (.*)$"), F.lit(1))
    return (
        texts.filter(is_exit_list(text))
        .withColumn("downloaded", download_time(text))
        .select(
            "path", "downloaded", F.explode_outer(sections(text, "ExitNode ")).alias("__node")
        )
        .filter(F.col("__node").startswith("ExitNode "))
        .select(
            "path",
            "downloaded",
            F.regexp_extract("__node", r"(?d)\AExitNode (.*)", 1).alias("node"),
            value("Published").alias("published"),
            value("LastStatus").alias("last_status"),
            F.explode_outer(address).alias("__a"),
        )
        .filter(F.col("__a").isNotNull())
        .select(
            "path",
            "downloaded",
            "node",
            "published",
            "last_status",
            F.element_at(F.split("__a", " "), 1).alias("address"),
            parse_time(F.regexp_extract("__a", r"\A\S+ (.*)\z", 1)).alias("scan_ts"),
        )
    )


def read_exit_lists(
    spark: SparkSession, folder: str, downloaded: datetime | None = None
) -> DataFrame:
    return parse_exit_lists(_texts(spark, folder), downloaded)


# --- transfer timings -------------------------------------------------------------------

def tpf_name(path: Column) -> tuple[Column, Column, Column]:
    """Source, size and date that a file of timings is named by."""
    name = F.element_at(F.split(path, "/"), -1)
    date = F.try_to_timestamp(F.regexp_extract(name, TPF_NAME, 3), F.lit("yyyy-MM-dd"))
    return (
        F.regexp_extract(name, TPF_NAME, 1),
        F.regexp_extract(name, TPF_NAME, 2).try_cast("int"),
        F.to_date(date),
    )


def timing_pairs(line: Column) -> Column:
    return F.str_to_map(line, F.lit(" "), F.lit("="))


def timing_fields(kv: Column) -> tuple[Column, Column, Column]:
    """Source, size and start of a row of timings."""
    return (
        F.try_element_at(kv, F.lit("SOURCE")),
        F.try_element_at(kv, F.lit("FILESIZE")).try_cast("int"),
        F.timestamp_seconds(F.try_element_at(kv, F.lit("START")).try_cast("double")),
    )


def parse_tpf(rows: DataFrame) -> DataFrame:
    """Pairs of timing rows (path, line), with what the file name says."""
    file_source, file_size, file_date = tpf_name(F.col("path"))
    source, filesize, start = timing_fields(F.col("kv"))
    return (
        rows.filter(F.col("line").contains("=") & ~F.col("line").startswith("@"))
        .withColumn("kv", timing_pairs(F.col("line")))
        .select(
            "path",
            file_source.alias("file_source"),
            file_size.alias("file_size"),
            file_date.alias("file_date"),
            source.alias("source"),
            filesize.alias("filesize"),
            start.alias("start"),
            "kv",
        )
    )


def read_tpf(spark: SparkSession, folder: str) -> DataFrame:
    rows = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.tpf")
        .text(folder)
        .select(file_path().alias("path"), F.col("value").alias("line"))
    )
    return parse_tpf(rows)


def _unpack_xz(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            text = error = None
            try:
                with lzma.open(io.BytesIO(content)) as f:
                    text = f.read().decode("utf-8", errors="replace")
            except (lzma.LZMAError, EOFError, OSError) as e:
                error = str(e) or type(e).__name__
            row = {"path": [path], "content": [content], "text": [text], "error": [error]}
            yield pd.DataFrame(row)


ANALYSIS_TEXTS = "path string, content binary, text string, error string"


def unpack_analyses(files: DataFrame) -> DataFrame:
    """Files of analyses (path, content) with their text, or the error met while unpacking."""
    return files.select("path", "content").mapInPandas(_unpack_xz, ANALYSIS_TEXTS)


def analysis_name(path: Column) -> tuple[Column, Column]:
    """Source and date of a file of analyses; a name without source lies in its source's folder."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    source = F.regexp_extract(name, ANALYSIS_NAME, 2)
    date = F.try_to_timestamp(F.regexp_extract(name, ANALYSIS_NAME, 1), F.lit("yyyy-MM-dd"))
    folder = F.when(name.rlike(ANALYSIS_NAME), F.try_element_at(parts, F.lit(-2)))
    return F.when(source != "", source).otherwise(F.coalesce(folder, F.lit(""))), F.to_date(date)


def analysis_transfers(text: Column) -> Column:
    """Transfers as raw JSON by source and id; null where a text is no analysis."""
    kind = "data map<string,struct<tgen:struct<transfers:map<string,string>>>>"
    return F.from_json(text, kind)["data"]


def parse_transfer_analysis(texts: DataFrame) -> DataFrame:
    """Transfers of analysis documents, one row each, with the raw JSON."""
    file_source, file_date = analysis_name(F.col("path"))
    return (
        texts.select(
            "path",
            file_source.alias("file_source"),
            file_date.alias("file_date"),
            F.explode(analysis_transfers(F.col("text"))).alias("source", "__s"),
        )
        .select(
            "path",
            "file_source",
            "file_date",
            "source",
            F.explode_outer("__s.tgen.transfers").alias("transfer_id", "raw"),
        )
        .withColumn("filesize", F.get_json_object("raw", "$.filesize_bytes").try_cast("int"))
        .withColumn(
            "start",
            F.timestamp_seconds(F.get_json_object("raw", "$.unix_ts_start").try_cast("double")),
        )
    )


def read_transfer_analysis(spark: SparkSession, folder: str) -> DataFrame:
    packed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.analysis.json.xz")
        .load(folder)
    )
    return parse_transfer_analysis(unpack_analyses(packed))


# --- statistics with an end line -----------------------------------------------------------


def split_statistics(texts: DataFrame, end_line: str, end: str) -> DataFrame:
    """Parts (path, pos, raw, ``end``, good) of texts: documents starting at ``end_line``, and
    what else there is, which is not good."""
    # an annotation belongs to the document after it
    clean = F.regexp_replace("text", r"(?dm)^@type [^\n]*\n(?=" + end_line + " )", "")
    parts = texts.select(
        "path", F.posexplode_outer(sections(clean, f"{end_line} ")).alias("pos", "raw")
    ).filter(~F.col("raw").rlike(r"\A\s*\z"))
    timed = parts.withColumn(
        end, parse_time(F.regexp_extract("raw", rf"(?d)\A{end_line} (\S+ \S+)", 1))
    )
    good = F.col(end).isNotNull() & ~F.col("raw").rlike(r"(?dm)^@type ")
    return timed.withColumn("good", good)


def _parse_stats(texts: DataFrame, end_line: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Documents starting at ``end_line``; everything else goes to the rejects."""
    parts = split_statistics(texts, end_line, end)
    rejected = parts.filter("NOT good").withColumn("raw", F.regexp_replace("raw", r"\A\n", ""))
    return parts.filter("good").drop("good"), rejected.drop(end, "good")


def parse_proxy_stats(texts: DataFrame) -> DataFrame:
    """Statistics documents (path, pos, raw, stats_end) of texts with many."""
    return _parse_stats(texts, PROXY_STATS_END, "stats_end")[0]


def read_proxy_stats(spark: SparkSession, folder: str) -> DataFrame:
    return parse_proxy_stats(_texts(spark, folder))


def parse_distributor_metrics(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics documents (path, pos, raw, metrics_end), and rejected texts."""
    return _parse_stats(texts, DISTRIBUTOR_METRICS_END, "metrics_end")


def read_distributor_metrics(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return parse_distributor_metrics(_texts(spark, folder))
