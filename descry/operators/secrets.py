"""Monthly secrets for keyed hashing."""

from __future__ import annotations

import secrets as random_bytes
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.formats import SECRET_BYTES
from descry.session import broadcast_if_small

SECRET_SCHEMA = "month string, secret binary"
# a century of months; more than this is no secrets table
MAX_MONTHS = 1_200


def month_of(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def with_month_secret(df: DataFrame, secrets: DataFrame, time: str = "published") -> DataFrame:
    """Add the secret of each row's month; null when there is none.

    The secrets side is one row per month, and its size is checked before it is
    broadcast, so a month with most of the rows is never shuffled.
    """
    side = broadcast_if_small(
        secrets.select(F.col("month").alias("__month"), "secret"), MAX_MONTHS
    )
    return df.join(side, month_of(F.col(time)) == F.col("__month"), "left").drop("__month")


def months_needing_secret(months: DataFrame, secrets: DataFrame) -> DataFrame:
    """Months without a full-length secret, with the prefix that must be kept."""
    short = secrets.withColumn("have", F.length("secret"))
    return (
        months.select("month")
        .distinct()
        .join(short, "month", "left")
        .filter(F.coalesce(F.col("have"), F.lit(0)) < SECRET_BYTES)
        .select("month", F.col("secret").alias("prefix"), F.coalesce("have", F.lit(0)).alias("have"))
    )


def ensure_secrets(
    months: DataFrame, secrets: DataFrame, cutoff: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """Secrets for all months, and the part of them to persist.

    Random bytes are drawn once, on the driver, before any job uses them: a task
    run twice must see the same secret.  Short secrets are extended and keep
    their prefix.  Months before the cut-off are usable but not persisted; the
    cut-off's own month is.
    """
    spark = secrets.sparkSession
    needed = months_needing_secret(months, secrets).limit(MAX_MONTHS + 1).collect()
    if len(needed) > MAX_MONTHS:
        raise ValueError(f"more than {MAX_MONTHS} months need a secret")
    drawn = []
    for row in needed:
        prefix = bytes(row.prefix or b"")
        drawn.append((row.month, bytearray(prefix + random_bytes.token_bytes(SECRET_BYTES - len(prefix)))))
    new = spark.createDataFrame(drawn, SECRET_SCHEMA)
    kept = secrets.select("month", "secret").join(new.select("month"), "month", "left_anti")
    everything = kept.unionByName(new)
    return everything, retained_secrets(everything, cutoff)


def retained_secrets(secrets: DataFrame, cutoff: datetime | None) -> DataFrame:
    """Secrets of the cut-off's month and later."""
    if cutoff is None:
        return secrets
    return secrets.filter(F.col("month") >= cutoff.strftime("%Y-%m"))


def with_all_secrets(df: DataFrame, secrets: DataFrame, alias: str = "secrets") -> DataFrame:
    """Add all secrets as a map from month to secret, at most a century of months.

    A scalar subquery: computed once, no join.
    """
    if secrets.limit(MAX_MONTHS + 1).count() > MAX_MONTHS:
        raise ValueError(f"more than {MAX_MONTHS} months of secrets")
    everything = secrets.agg(F.map_from_entries(F.collect_list(F.struct("month", "secret"))))
    return df.withColumn(alias, everything.scalar())
