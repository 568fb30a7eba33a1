"""Identity, deduplication and set operators.

None of these gathers the copies of one key in one task: rank filters are
pushed below the shuffle as group limits, and everything else is a combinable
aggregate or an anti/semi join whose hot side AQE can split.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_RANK = "__rank"


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_RANK, rank).filter(F.col(_RANK) <= k).drop(_RANK)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``.

    ``row_number() <= 1`` becomes a group limit on both sides of the shuffle, so
    a key with a third of all rows sends one row per map task.
    """
    return _ranked(df, keys, [F.col(c).asc() for c in order], 1)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order`` (a later duplicate replaces earlier)."""
    return _ranked(df, keys, [F.col(c).desc() for c in order], 1)


def last_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 3) -> DataFrame:
    """The last ``k`` rows per key; without keys the last ``k`` of all."""
    descending = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*descending).limit(k)
    return _ranked(df, keys, descending, k)


def skip_processed(df: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop inputs whose key is in the state of processed keys."""
    return df.join(state.select(*keys).distinct(), list(keys), "left_anti")


def only_processed(df: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(state.select(*keys).distinct(), list(keys), "left_semi")


def new_rows(
    incoming: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """First write wins: rows a table does not have yet, one per key.

    Copies go first, so that no popular key reaches the join.
    """
    return skip_processed(keep_first(incoming, keys, order), existing, keys)


def overwritten(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Last write wins: incoming rows replace existing ones of the same key."""
    source = "__incoming"
    both = existing.withColumn(source, F.lit(0)).unionByName(incoming.withColumn(source, F.lit(1)))
    return keep_last(both, keys, [source, *order]).drop(source)


def union_sources(
    sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Union of all sources; a document found in several counts once.

    An earlier source wins, then the first row in ``order``.
    """
    rank = "__source"
    tagged = [s.withColumn(rank, F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_first(both, keys, [rank, *order]).drop(rank)


def known_set(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Distinct keys over several frames of stored documents."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*keys) for p in parts]).distinct()


def merge_counts(parts: Sequence[DataFrame], keys: Sequence[str], count: str = "n") -> DataFrame:
    """Add per-key counts of several frames."""
    both = reduce(lambda a, b: a.unionByName(b), [p.select(*keys, count) for p in parts])
    return both.groupBy(*keys).agg(F.sum(count).alias(count))


def insert_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edge set insert: an edge already present keeps its weight and expiry."""
    return union_sources(
        [existing, incoming], ["referencing", "referenced"], ["expires_at", "weight"]
    )


def accumulate(state: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Processed keys of this run and of all earlier runs."""
    return known_set([state, seen], keys)


def without_groups(df: DataFrame, keys: Sequence[str], bad: Column) -> DataFrame:
    """Drop every group holding at least one bad row.

    Only the keys of bad groups are shuffled against the rows; no group is
    collected.
    """
    bad_keys = df.filter(F.coalesce(bad, F.lit(True))).select(*keys).distinct()
    return df.join(bad_keys, list(keys), "left_anti")


def run_counters(df: DataFrame, type_col: str, outcome_col: str) -> DataFrame:
    """Rows per type and outcome (parsed, skipped, stored, rejected)."""
    return df.groupBy(type_col, outcome_col).agg(F.count(F.lit(1)).alias("n"))
