"""Sharding by jump consistent hashing.

The shard of a key follows from the key and the number of shards alone: there is no
table of ring positions, and when a shard is appended a key either stays or moves into
the new shard.  Everything is an expression; the only shuffle numbers the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.functions.text import let, once
from descry.llm.common import hidden, prefix_sums, shown, text_of

#: Fixed value: multiplier of the linear congruential generator of jump hashing.
MULTIPLIER = 2862933555777941757
HALF = 0xFFFFFFFF
MULTIPLIER_HIGH, MULTIPLIER_LOW = MULTIPLIER >> 32, MULTIPLIER & HALF
#: Steps tried first; a key needs about ln(shards), the rare rest goes on to the end.
FIRST_STEPS = 32
#: Ranges of the numbering inside a shard.
RANGES = 1024


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(HALF))


def _times(x: Column, factor: int) -> Column:
    """Low 32 bits of a product of two 32-bit numbers, without overflow of a long."""
    high = _low(F.shiftright(x, 16) * (factor & 0xFFFF))
    return x.bitwiseAND(F.lit(0xFFFF)) * factor + F.shiftleft(high, 16)


def _next(high: Column, low: Column) -> Column:
    """The generator's next state modulo 2**64, as two halves of 32 bits."""
    upper = F.shiftright(low, 16) * MULTIPLIER_LOW
    lower = low.bitwiseAND(F.lit(0xFFFF)) * MULTIPLIER_LOW
    total = lower + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    carry = F.shiftright(total, 32) + F.shiftright(upper, 16)
    top = _low(carry + _low(_times(high, MULTIPLIER_LOW)) + _low(_times(low, MULTIPLIER_HIGH)))
    return F.struct(top.alias("high"), _low(total).alias("low"))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a long key, 0 to ``shards`` - 1; a null key counts as key 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def step(state: Column, _: Column) -> Column:
        def moved(s: Column) -> Column:
            scaled = (state["jump"] + 1).cast("double") * F.lit(float(1 << 31))
            return F.struct(
                s["high"].alias("high"),
                s["low"].alias("low"),
                state["jump"].alias("shard"),
                F.floor(scaled / (F.shiftright(s["high"], 1) + 1).cast("double")).alias("jump"),
            )

        return F.when(state["jump"] >= shards, state).otherwise(
            let(_next(state["high"], state["low"]), moved)
        )

    def steps(start: Column, most: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)

    start = F.struct(
        _low(F.shiftrightunsigned(key, 32)).alias("high"),
        _low(key).alias("low"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("jump"),
    )
    first = steps(start, min(shards, FIRST_STEPS))
    if shards <= FIRST_STEPS:
        return first["shard"].cast("int")
    # the shard grows with each step, so as many steps as shards always suffice
    return let(
        first,
        lambda s: F.when(s["jump"] >= shards, s["shard"]).otherwise(steps(s, shards)["shard"]),
    ).cast("int")


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Rows, hidden, beside ``shard`` and ``grown_shard``, that with one shard more."""
    return hidden(
        df,
        shard=jump_shard(F.col(f"`{key}`"), shards),
        grown_shard=jump_shard(F.col(f"`{key}`"), shards + 1),
    )


def sharded_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Documents placed in shards and numbered in each by (doc_id, text).

    Size is the text's UTF-8 bytes plus 1.  A null text has the size 1 and the checksum
    of the empty text; a null doc_id is placed as key 0 and numbered first.  Rows that
    are equal in doc_id and text get neighbouring slots.  An empty table gives no rows;
    other columns, whatever their names, are not read.

    Slots run by ranges of doc_id (of checksums where doc_id is null).  The bounds are
    quantiles of doc_id, some hundred numbers; they only decide which task counts.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    at = [i / RANGES for i in range(1, RANGES)]
    bounds = sorted(set(ids.approxQuantile("id", at, 0.25 / RANGES)))
    text = text_of("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = once(
        rows,
        shard=jump_shard(F.col("doc_id"), shards),
        grown_shard=jump_shard(F.col("doc_id"), shards + 1),
        part=F.when(
            F.col("doc_id").isNull(), F.shiftright("text_crc32", 22) - RANGES
        ).otherwise(_range_of(F.col("doc_id").cast("double"), bounds)),
        one=F.lit(1).cast("long"),
    )
    numbered = prefix_sums(rows, ["shard"], "part", ["doc_id", "text_crc32", "size"], "one", "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _range_of(value: Column, bounds: list[float]) -> Column:
    """Number of bounds at or below the value, by bisection of a literal array."""
    if not bounds:
        return F.lit(0).cast("long")
    array = F.array(*[F.lit(float(b)) for b in bounds])

    def step(state: Column, half: Column) -> Column:
        probe = state + half
        return F.when(
            (probe <= len(bounds)) & (F.try_element_at(array, probe.cast("int")) <= value), probe
        ).otherwise(state)

    halves = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(h).cast("long") for h in halves]), F.lit(0).cast("long"), step
    )


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write rows as one folder for each shard, large shards as several files."""
    placed = assign_shards(df, key, shards)
    placed = placed.select(*shown(placed), F.col("shard").alias("_shard"))
    placed.hint("rebalance", "_shard").write.partitionBy("_shard").parquet(path)
