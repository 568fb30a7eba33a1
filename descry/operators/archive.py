"""Paths, annotations, bundles and merging of archives."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.formats import ANNOTATIONS, BUNDLES, LAYOUTS, UNDATED_BUNDLES
from descry.functions.text import as_bytes, as_text
from descry.functions.times import at
from descry.operators.keys import new_rows


def _path(layout: str, time: Column, digest: Column | None, received: datetime | None) -> Column:
    dated = {
        "Y": "yyyy",
        "M": "MM",
        "D": "dd",
        "ts": "yyyy-MM-dd-HH-mm-ss",
        "date": "yyyy-MM-dd",
        "ymd": "yyyyMMdd",
        "hms": "HHmmss",
    }

    def field(name: str) -> Column:
        if name in dated:
            return F.date_format(time, dated[name])
        if name == "received":
            return F.lit(received.strftime("%Y-%m-%d-%H-%M-%S") if received else "")
        if name in ("d", "DU", "d0", "d1"):
            lower = F.lower(digest)
            return {
                "d": lower,
                "DU": F.upper(digest),
                "d0": F.substring(lower, 1, 1),
                "d1": F.substring(lower, 2, 1),
            }[name]
        return F.col(name).cast("string")

    pieces = re.split(r"\{(\w+)\}", layout)
    columns = [F.lit(p) if i % 2 == 0 else field(p) for i, p in enumerate(pieces) if p]
    return F.concat(*columns)


def with_archive_paths(
    df: DataFrame,
    kind: str,
    time: str = "published",
    digest: str = "digest",
    received: datetime | None = None,
) -> DataFrame:
    """Add ``storage_path`` and ``recent_path`` of a kind's documents."""
    storage, recent = LAYOUTS[kind]
    d = F.col(digest) if "{d" in storage or "{DU}" in storage else None
    return df.withColumn("storage_path", _path(storage, F.col(time), d, received)).withColumn(
        "recent_path", _path(recent, F.col(time), d, received)
    )


def with_annotation(
    df: DataFrame, kind: str, raw: str = "raw", source: str | None = None
) -> DataFrame:
    """Prepend the default annotation to documents that carry none.

    ``source`` names a column added as a second annotation.
    """
    head = F.lit(f"@type {ANNOTATIONS[kind]}\n")
    if source:
        named = F.concat(F.lit("@source "), F.col(source), F.lit("\n"))
        head = F.concat(head, F.coalesce(named, F.lit("")))
    text = as_text(F.col(raw))
    annotate = (F.length(raw) > 0) & ~text.startswith("@")
    return df.withColumn(
        raw, F.when(annotate, as_bytes(F.concat(head, text))).otherwise(F.col(raw))
    )


def annotated_kind(text: Column) -> Column:
    """Kind named by a document's type annotation, whatever its version."""
    names = {a.split(" ")[0]: kind for kind, a in ANNOTATIONS.items()}
    kinds = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(kinds, F.regexp_extract(text, r"\A@type (\S+) \d+\.\d+", 1))


def type_filter(df: DataFrame, wanted: Iterable[str], kind: str = "kind") -> DataFrame:
    """Only documents of the kinds expected here."""
    return df.filter(F.col(kind).isin(*wanted))


def bundle_name(kind: Column, time: Column) -> Column:
    """Monthly bundle of a document; certificates share one undated bundle."""
    case = F.when(F.lit(False), F.lit(""))
    for name, bundle in BUNDLES.items():
        value = (
            F.lit(bundle)
            if bundle in UNDATED_BUNDLES
            else F.concat(F.lit(bundle + "-"), F.date_format(time, "yyyy-MM"))
        )
        case = case.when(kind == name, value)
    return case


def assign_monthly_bundle(
    df: DataFrame,
    now: datetime,
    kind: str = "kind",
    time: str = "published",
    lookback: timedelta = timedelta(days=7),
) -> DataFrame:
    """Documents of the bundles this run rebuilds, with their ``bundle``.

    Rebuilt are this month's, last week's month's and the undated bundles.  The
    month test is a plain time range, so it reaches the scan.
    """
    start = (now - lookback).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    next_month = (now.replace(day=1) + timedelta(days=32)).replace(
        day=1, hour=0, minute=0, second=0, microsecond=0
    )
    undated = [k for k, b in BUNDLES.items() if b in UNDATED_BUNDLES]
    current = (F.col(time) >= at(start)) & (
        F.col(time) < at(next_month)
    )
    return df.filter(current | F.col(kind).isin(*undated)).withColumn(
        "bundle", bundle_name(F.col(kind), F.col(time))
    )


def merge_sync(
    local: DataFrame,
    remote: DataFrame,
    wanted: Iterable[str],
    keys: Sequence[str] = ("storage_path",),
    order: Sequence[str] = ("storage_path",),
    kind: str = "kind",
) -> DataFrame:
    """Local rows plus the remote rows of wanted kinds that local lacks."""
    accepted = new_rows(type_filter(remote, wanted, kind), local, keys, order)
    return local.unionByName(accepted)


def recent_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows sorted inside their recent file, large files over several tasks."""
    keys = ["recent_path", *order]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)

