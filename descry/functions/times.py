"""Points in time and spans as columns.  Naive datetimes are UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(time: datetime) -> Column:
    """A literal that does not depend on the time zone of the Python process."""
    if time.tzinfo is not None:
        time = time.astimezone(timezone.utc)
    return F.lit(time.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def span(delta: timedelta) -> Column:
    return F.make_dt_interval(secs=F.lit(delta.total_seconds()))
