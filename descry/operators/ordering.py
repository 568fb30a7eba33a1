"""Operators that depend on order, written for groups of any size.

A plain window over a hot group (or over everything) would run in one task.
Here a group is cut into blocks of positions, or all rows into range
partitions; only one small row per block passes through the ordered step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POSITIONS_PER_BLOCK = 65_536
#: Ranges that rows are cut into at most, and rows looked at for each bound.
MOST_BLOCKS, SAMPLED_PER_BLOCK = 256, 32
_BLOCK, _CARRY, _ROW = "__block", "__carry", "__row"


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    alias: str,
    positions_per_block: int = POSITIONS_PER_BLOCK,
) -> DataFrame:
    """The latest non-null ``value`` at or before each row of its group.

    ``position`` is a whole number, unique within the group.
    """
    keys = list(keys)
    rows = df.withColumn(alias, value).withColumn(
        _BLOCK, F.floor(F.col(position) / positions_per_block)
    )
    last_per_block = rows.groupBy(*keys, _BLOCK).agg(
        F.max_by(alias, F.when(F.col(alias).isNotNull(), F.col(position))).alias(_CARRY)
    )
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried_in = last_per_block.withColumn(_CARRY, F.last(_CARRY, ignorenulls=True).over(before))
    within = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(carried_in, [*keys, _BLOCK])
        .withColumn(alias, F.coalesce(F.last(alias, ignorenulls=True).over(within), F.col(_CARRY)))
        .drop(_BLOCK, _CARRY)
    )


def cut_at_first_bad(
    df: DataFrame, keys: Sequence[str], position: str, bad: Column
) -> DataFrame:
    """Rows of each group before its first bad row.

    The first bad position is a combinable minimum over the bad rows alone.
    """
    keys = list(keys)
    first_bad = df.filter(bad).groupBy(*keys).agg(F.min(position).alias("__first_bad"))
    return (
        df.join(first_bad, keys, "left")
        .filter(F.col("__first_bad").isNull() | (F.col(position) < F.col("__first_bad")))
        .drop("__first_bad")
    )


def range_bounds(df: DataFrame, order: Sequence[str], blocks: int) -> list[Row]:
    """Keys that cut the rows into about ``blocks`` equal ranges, least first.

    They are quantiles of the rows with the least hashes, a fixed number of them, so they
    are the same each time and the driver gets no more than that.
    """
    sample = df.select(*order).orderBy(F.xxhash64(*order)).limit(SAMPLED_PER_BLOCK * blocks)
    rows = sample.distinct().orderBy(*order).collect()
    cuts = sorted({len(rows) * k // blocks for k in range(1, blocks)})
    return [rows[k] for k in cuts if 0 < k < len(rows)]


def _block_of(df: DataFrame, order: Sequence[str], bounds: Sequence[Row]) -> Column:
    """How many bounds are at most a row's key, by halving."""
    key = F.struct(*order)
    types = [df.schema[c].dataType for c in order]

    def bound(row: Row) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(row, types, order)])

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bound(bounds[middle]), between(low, middle)).otherwise(
            between(middle + 1, high)
        )

    return between(0, len(bounds))


def _in_range_blocks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with the range they fall in.

    The bounds are literals, so a row falls in the same range each time it is computed and
    nothing has to be written.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(df, order, max(1, min(partitions, MOST_BLOCKS)))
    return df.withColumn(_BLOCK, _block_of(df, order, bounds))


def _offsets(
    blocks: DataFrame, keys: Sequence[str], total: Column, alias: str
) -> DataFrame:
    """Exclusive prefix sums over blocks; one row per key and block."""
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = before.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    per_block = blocks.groupBy(*keys, _BLOCK).agg(total.alias("__total"))
    return per_block.select(
        *keys, _BLOCK, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias(alias)
    )


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str = "row_index"
) -> DataFrame:
    """Zero-based rank per key in ``order``, with the sort spread over tasks.

    ``order`` must be a total order within a key.
    """
    keys = list(keys)
    blocks = _in_range_blocks(df, [*keys, *order])
    offsets = _offsets(blocks, keys, F.count(F.lit(1)), "__offset")
    within = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    return (
        blocks.withColumn(_ROW, F.row_number().over(within) - 1)
        .join(offsets, [*keys, _BLOCK])
        .withColumn(alias, F.col(_ROW) + F.col("__offset"))
        .drop(_BLOCK, _ROW, "__offset")
    )


def running_total(
    df: DataFrame, order: Sequence[str], amount: Column, alias: str
) -> DataFrame:
    """Running sum of ``amount`` over all rows in ``order``, a total order."""
    blocks = _in_range_blocks(df.withColumn(alias, amount), order)
    offsets = _offsets(blocks, [], F.sum(alias), "__offset")
    within = (
        Window.partitionBy(_BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        blocks.withColumn(alias, F.sum(alias).over(within))
        .join(offsets, _BLOCK)
        .withColumn(alias, F.col(alias) + F.col("__offset"))
        .drop(_BLOCK, "__offset")
    )


def batch_keys(
    df: DataFrame,
    type_col: str,
    key_col: str,
    size_of: Callable[[Column], Column],
    separator_of: Callable[[Column], Column],
) -> DataFrame:
    """Pack sorted distinct keys into batches, joined with a separator.

    A batch has a fixed small size, so collecting it is bounded.
    """
    distinct = df.select(type_col, key_col).distinct()
    indexed = row_index(distinct, [type_col], [key_col])
    batch = F.floor(F.col("row_index") / size_of(F.col(type_col))).alias("batch")
    return (
        indexed.groupBy(type_col, batch)
        .agg(
            F.count(F.lit(1)).alias("n_keys"),
            F.array_sort(F.collect_list(key_col)).alias("keys"),
        )
        .select(
            type_col,
            "batch",
            "n_keys",
            F.array_join("keys", "\x00").alias("keys"),
        )
        .withColumn("keys", F.replace("keys", F.lit("\x00"), separator_of(F.col(type_col))))
    )
