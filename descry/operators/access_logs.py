"""Access logs: parse, sanitize, count, and decide which days may be stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from descry.formats import (
    DROPPED_LOG_STATUSES,
    KEPT_LOG_METHODS,
    LOG_LINE_PATTERN,
    LOG_METHODS,
    LOG_PATH_PATTERN,
)
from descry.functions.text import once
from descry.operators.keys import keep_last, merge_counts

HOSTS = ("virtual_host", "physical_host")
LINE_KEYS = (*HOSTS, "log_date", "line")

_SEP = "\x01"


def parse_log_path(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Virtual host, physical host and date from a log's path; others dropped."""
    name = F.element_at(F.split(path_col, "/"), -1)
    parent = F.try_element_at(F.split(path_col, "/"), F.lit(-2))
    part = lambda i: F.regexp_extract(name, LOG_PATH_PATTERN, i)
    return once(
        df,
        virtual_host=part(1),
        physical_host=parent,
        file_date=F.to_date(F.try_to_timestamp(part(2), F.lit("yyyyMMdd"))),
        file_type=F.lower(part(3)),
    ).filter(
        (F.col("virtual_host") != "")
        & (F.col("physical_host") != "")
        & F.col("file_date").isNotNull()
    )


def latest_log_files(files: DataFrame) -> DataFrame:
    """One file per host pair and date: the largest path."""
    return keep_last(files, [*HOSTS, "file_date"], ["path"])


def parse_access_log(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Combined-log fields of valid lines; the date is the UTC date.

    The pattern runs once per line: a match is rewritten to separated fields,
    the free-text request last, and recognised by its leading separator.
    """
    line = F.col(line_col)
    rewritten = F.regexp_replace(
        line,
        "(?s)" + LOG_LINE_PATTERN.replace("(.*)", "[^\\n]*") + ".*",
        _SEP + _SEP.join(["$1", "$4$5$6", "$7", "$9", "$10", "$11", "$8"]),
    )
    f = F.col("__f")
    fields = F.when(~line.startswith(_SEP), F.split(rewritten, _SEP, 8))
    matched = once(df, __f=fields).filter((F.size(f) == 8) & (f[0] == ""))
    time = F.try_to_timestamp(f[2], F.lit("dd/MMM/yyyy:HH:mm:ss xx"))
    return (
        once(
            matched,
            ip=f[1],
            log_date=F.to_date(time),
            method=f[3],
            protocol=f[4],
            status=f[5].try_cast("int"),
            size=F.nullif(f[6], F.lit("-")).try_cast("int"),
            request=f[7],
        )
        .filter(
            F.col("log_date").isNotNull()
            & F.col("status").isNotNull()
            & F.col("method").isin(*LOG_METHODS)
            & (F.col("size").isNotNull() | (f[6] == "-"))
        )
        .drop("__f")
    )


def strip_query(request: Column) -> Column:
    """Cut at the first question mark unless it is the first character."""
    return F.regexp_replace(request, r"(?s)\A([^?]+)\?.*\z", "$1")


def sanitize_access_log(df: DataFrame) -> DataFrame:
    """Keep harmless requests and rebuild the line without personal data."""
    kept = df.filter(
        F.col("method").isin(*KEPT_LOG_METHODS)
        & F.col("protocol").startswith("HTTP")
        & ~F.col("status").isin(*DROPPED_LOG_STATUSES)
    )
    return (
        kept.withColumn(
            "ip", F.when(F.col("ip").startswith("0.0.0."), F.col("ip")).otherwise("0.0.0.0")
        )
        .withColumn("request", strip_query(F.col("request")))
        .withColumn(
            "line",
            F.concat(
                "ip",
                F.lit(" - - ["),
                F.date_format("log_date", "dd/MMM/yyyy"),
                F.lit(':00:00:00 +0000] "'),
                F.concat_ws(" ", "method", "request", "protocol"),
                F.lit('" '),
                F.col("status").cast("string"),
                F.lit(" "),
                F.coalesce(F.col("size").cast("string"), F.lit("-")),
            ),
        )
    )


def count_sanitized_lines(df: DataFrame, keys: Sequence[str] = LINE_KEYS) -> DataFrame:
    """Lines per host pair and date, counted before and after the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def safe_dates(df: DataFrame, limits: bool = True, hosts: Sequence[str] = HOSTS) -> DataFrame:
    """Dates per host pair that no later input should still change.

    With limits on, the newest date is ignored and so are both ends of the rest.
    After ``distinct`` a host pair has one row per calendar date.
    """
    dates = df.select(*hosts, "log_date").distinct()
    if not limits:
        return dates
    pair = Window.partitionBy(*hosts)
    return (
        dates.withColumn("__up", F.row_number().over(pair.orderBy(F.col("log_date").asc())))
        .withColumn("__down", F.row_number().over(pair.orderBy(F.col("log_date").desc())))
        .filter((F.col("__up") > 1) & (F.col("__down") > 2))
        .drop("__up", "__down")
    )


def dates_not_stored(dates: DataFrame, archive: DataFrame, hosts: Sequence[str] = HOSTS) -> DataFrame:
    """Drop dates already in the archive: late lines never change a stored day."""
    keys = [*hosts, "log_date"]
    return dates.join(archive.select(*keys).distinct(), keys, "left_anti")


def files_to_reprocess(
    processed: DataFrame, store_dates: DataFrame, hosts: Sequence[str] = HOSTS
) -> DataFrame:
    """Files read before that hold a date about to be stored."""
    keys = [*hosts, "log_date"]
    return (
        processed.join(store_dates.select(*keys).distinct(), keys, "left_semi")
        .select(*hosts, "path")
        .distinct()
    )


def merge_line_counts(parts: Sequence[DataFrame]) -> DataFrame:
    return merge_counts(parts, LINE_KEYS)


def count_chunks(df: DataFrame, count: str = "n", lines_per_chunk: int = 100_000) -> DataFrame:
    """One row per ``lines_per_chunk`` copies: ``first_copy`` and ``last_copy``.

    A count of zero has no chunk.
    """
    last = F.floor((F.col(count) - 1) / lines_per_chunk)
    first_copy = F.col("__chunk") * lines_per_chunk + 1
    return (
        df.filter(F.col(count) > 0)
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("first_copy", first_copy)
        .withColumn("last_copy", F.least(F.col(count), first_copy + lines_per_chunk - 1))
        .drop("__chunk")
    )


def repeat_chunks(chunks: DataFrame) -> DataFrame:
    """One row per copy, in the order of the chunks."""
    return chunks.withColumn("copy", F.explode(F.sequence("first_copy", "last_copy"))).drop(
        "first_copy", "last_copy"
    )


def expand_counts(df: DataFrame, count: str = "n", lines_per_chunk: int = 100_000) -> DataFrame:
    """Repeat each row ``n`` times.

    A large count is first cut into chunks that are spread over tasks, so one
    hot line neither builds one huge array nor fills one task.
    """
    chunks = count_chunks(df, count, lines_per_chunk)
    return repeat_chunks(chunks.repartition(*df.columns, "first_copy"))
