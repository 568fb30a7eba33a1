"""Staleness, retention and refresh limits.  ``now`` is always passed in."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.formats import (
    FULL_REFRESH_AFTER,
    STALE_AFTER,
    STALE_CACHE_AFTER,
    STALE_PROXY_STATS_AFTER,
)
from descry.functions.times import at


STALE_BY_TYPE = {"proxy-stats": STALE_PROXY_STATS_AFTER, "cached-consensus": STALE_CACHE_AFTER}


def latest_and_stale(
    df: DataFrame,
    now: datetime,
    type_col: str = "kind",
    time_col: str = "published",
    after: timedelta = STALE_AFTER,
    after_by_type: dict[str, timedelta] = STALE_BY_TYPE,
) -> DataFrame:
    """Latest time per type and whether it lies too far back."""
    limit = at(now - after)
    for name, delta in after_by_type.items():
        limit = F.when(F.col(type_col) == name, at(now - delta)).otherwise(limit)
    return (
        df.groupBy(type_col)
        .agg(F.max(time_col).alias("latest"))
        .withColumn("stale", F.col("latest") < limit)
    )


def max_scan_time(
    df: DataFrame, keys: Sequence[str], scan_col: str, now: datetime, after: timedelta = STALE_AFTER
) -> DataFrame:
    """Last scan per list and whether it lies too far back."""
    return (
        df.groupBy(*keys)
        .agg(F.max(scan_col).alias("last_scan"))
        .withColumn("stale", F.col("last_scan") < at(now - after))
    )


def retention(
    df: DataFrame,
    time_col: str,
    now: datetime,
    keep: timedelta,
    exempt: Column | None = None,
) -> DataFrame:
    """Rows not older than ``keep``; exempt rows are kept for good."""
    young = F.col(time_col) >= at(now - keep)
    return df.filter(young if exempt is None else young | exempt)


def unexpired(edges: DataFrame, now: datetime) -> DataFrame:
    return edges.filter(F.col("expires_at") >= at(now))


def throttle_full_refresh(
    authorities: DataFrame,
    now: datetime,
    name: str = "authority",
    last: str = "last_refresh",
    at_most: int = 2,
    after: timedelta = FULL_REFRESH_AFTER,
) -> DataFrame:
    """At most two authorities not refreshed lately, in name order."""
    due = F.col(last).isNull() | (F.col(last) < at(now - after))
    return authorities.filter(due).orderBy(name).limit(at_most)
