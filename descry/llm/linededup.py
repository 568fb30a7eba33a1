"""Removal of lines that several documents share, with a reversible state.

The state has three parts.  ``holdings`` is the exact reference table: which document
holds which line.  No number is stored: ``counts`` has the lines that at least two documents
hold and the first of them, and changes form it anew from the holdings of touched lines.  ``filters`` has for each shard of the lines a cuckoo filter of those that at
least two documents hold.  A line that a filter doesn't know is surely not shared and
goes no further; what it does know is verified against ``counts``.  Cuckoo filters
forget as well as they learn, so documents can be deleted: holdings go, and a line that
only one document still holds leaves its filter.

A line's key is its text without white space at the ends, A-Z in lower case; a short key
is never dropped.  The tables hold 128-bit hashes of keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.common import hidden, shown
from descry.session import checkpointed

#: Least code points of a key that can be dropped.
LEAST_LENGTH = 10
#: Shared lines that a filter is made for, on average, and the fewest shards.
LINES_PER_SHARD = 1 << 17
LEAST_SHARDS = 8
#: Parts in which the lines of a shard pass its filter, so that no line is a hot spot.
SALTS = 32

SLOTS = 4
#: Moves before a filter is full.  A full filter answers "maybe" to all, which is right.
MOST_MOVES = 500


class CuckooFilter:
    """Set of 128-bit hashes that may claim too much but never too little."""

    def __init__(self, slots: bytes | None = None, expected: int = 0, full: bool = False):
        if slots is None:
            buckets = 1 << max(4, int(expected / SLOTS / 0.8).bit_length())
            self.slots = np.zeros((buckets, SLOTS), np.uint16)
        else:
            self.slots = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
        self.full = full
        self._mask = len(self.slots) - 1
        self._turn = 0

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mark (never zero), first bucket and second bucket of each key."""
        marks = (hashes[:, 1] % np.uint64(0xFFFF) + np.uint64(1)).astype(np.int64)
        first = (hashes[:, 0] & np.uint64(self._mask)).astype(np.int64)
        return marks, first, first ^ self._turned(marks)

    def _turned(self, mark):
        return (mark * 0x5BD1E995 >> 7) & self._mask

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(hashes), bool)
        marks, first, second = self._places(hashes)
        found = (self.slots[first] == marks[:, None]).any(axis=1)
        return found | (self.slots[second] == marks[:, None]).any(axis=1)

    def add(self, hashes: np.ndarray) -> None:
        """Each key must be added once only."""
        for mark, a, b in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            if not self.full and not self._put(mark, a) and not self._put(mark, b):
                self._move(mark, b)

    def _put(self, mark: int, bucket: int) -> bool:
        for slot in range(SLOTS):
            if self.slots[bucket, slot] == 0:
                self.slots[bucket, slot] = mark
                return True
        return False

    def _move(self, mark: int, bucket: int) -> None:
        for _ in range(MOST_MOVES):
            self._turn = (self._turn + 1) % SLOTS
            mark, self.slots[bucket, self._turn] = int(self.slots[bucket, self._turn]), mark
            bucket ^= int(self._turned(mark))
            if self._put(mark, bucket):
                return
        self.full = True

    def remove(self, hashes: np.ndarray) -> None:
        """Each key must have been added before."""
        if self.full:
            return
        for mark, *buckets in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            place = next((b, s) for b in buckets for s in range(SLOTS) if self.slots[b, s] == mark)
            self.slots[place] = 0

    def row(self, shard: int) -> pd.DataFrame:
        slots = self.slots.tobytes()
        return pd.DataFrame({"shard": [shard], "slots": [slots], "full": [self.full]})


FILTER = "shard int, slots binary, full boolean"


def line_key(line: bytes) -> bytes | None:
    """Hash of a UTF-8 line's key, none if the key is short."""
    key = line.strip().lower()
    if len(key) < LEAST_LENGTH or (
        not key.isascii() and len(key.decode("utf-8", "replace")) < LEAST_LENGTH
    ):
        return None
    return xxhash.xxh3_128_digest(key)


def line_holdings(docs: DataFrame) -> DataFrame:
    """(doc_id, key) of each different long line of each row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                held = {line_key(line) for line in (text.as_py() or b"").split(b"\n")} - {None}
                found += held
                rows += [row] * len(held)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(found, pa.binary())], ["doc_id", "key"]
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(keys, "doc_id long, key binary")


@dataclass
class LineState:
    """Tables of the state; ``counts`` has the lines that at least two documents hold."""

    holdings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


#: A null doc_id is one more document, after all others; it is spelled as no id at all.
def _counted(holdings: DataFrame) -> DataFrame:
    """(key, first_doc, shared): combined before the shuffle, so no line is a hot spot."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    ends = holdings.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    return ends.select(
        "key", F.col("low.id").alias("first_doc"), (F.col("low") != F.col("high")).alias("shared")
    )


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _built(counts: DataFrame, shards: int) -> DataFrame:
    """A cuckoo filter for each shard that has shared lines; its lines are a bounded group."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter(expected=len(rows))
        made.add(CuckooFilter.hashes(rows["key"].tolist()))
        return made.row(key[0])

    keys = counts.select("key", _shard(shards).alias("shard"))
    return keys.groupBy("shard").applyInPandas(build, FILTER)


def started(docs: DataFrame) -> LineState:
    """State of a first set of documents."""
    holdings = checkpointed(line_holdings(docs))
    counts = checkpointed(_counted(holdings).where("shared").select("key", "first_doc"))
    shards = LEAST_SHARDS
    while shards * LINES_PER_SHARD < counts.count():
        shards *= 2
    return LineState(holdings, counts, checkpointed(_built(counts, shards)), shards)


def inserted(state: LineState, docs: DataFrame) -> LineState:
    """State with further documents; what it knows of a document already is not added twice."""
    new = checkpointed(_lacking(line_holdings(docs).distinct(), state.holdings, ["doc_id", "key"]))
    holdings = checkpointed(state.holdings.unionByName(new))
    return _changed(state, holdings, new.select("key").distinct())


def deleted(state: LineState, ids: DataFrame) -> LineState:
    """State without the documents named in ``ids`` (doc_id)."""
    gone = ids.select(F.col("doc_id").cast("long")).distinct()
    rest = checkpointed(_lacking(state.holdings, gone, ["doc_id"]))
    lost = _meeting(state.holdings, gone, ["doc_id"], "left_semi")
    return _changed(state, rest, lost.select("key").distinct())


def _meeting(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"_{c}") for c in on])
    condition = F.lit(True)
    for c in on:
        condition &= left[c].eqNullSafe(right[f"_{c}"])
    return left.join(right, condition, how)


def _lacking(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return _meeting(left, right, on, "left_anti")


def _changed(state: LineState, holdings: DataFrame, touched: DataFrame) -> LineState:
    """Counts of touched lines formed anew; lines that became or ceased to be shared pass on
    to the filters."""
    touched = checkpointed(touched)
    anew = _counted(holdings.join(touched, "key", "left_semi")).where("shared")
    untouched = state.counts.join(touched, "key", "left_anti")
    counts = checkpointed(untouched.unionByName(anew.select("key", "first_doc")))
    came = counts.join(state.counts, "key", "left_anti").withColumn("add", F.lit(True))
    went = state.counts.join(counts, "key", "left_anti").withColumn("add", F.lit(False))
    changes = came.unionByName(went).select(_shard(state.shards).alias("shard"), "key", "add")

    def update(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        adds = rows.loc[rows["add"], "key"].tolist()
        removes = rows.loc[~rows["add"], "key"].tolist()
        if len(old):
            made = CuckooFilter(old["slots"].iloc[0], full=bool(old["full"].iloc[0]))
        else:
            made = CuckooFilter(expected=max(len(adds), LINES_PER_SHARD))
        made.remove(CuckooFilter.hashes(removes))
        made.add(CuckooFilter.hashes(adds))
        return made.row(key[0])

    filters = (
        state.filters.groupBy("shard")
        .cogroup(changes.groupBy("shard"))
        .applyInPandas(update, FILTER)
    )
    return LineState(holdings, counts, checkpointed(filters), state.shards)


def rebuilt(state: LineState) -> LineState:
    """The same state with filters made anew, for as many shards as its lines need now."""
    shards = LEAST_SHARDS
    while shards * LINES_PER_SHARD < state.counts.count():
        shards *= 2
    return LineState(
        state.holdings, state.counts, checkpointed(_built(state.counts, shards)), shards
    )


def filtered(holdings: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Holdings whose line its shard's filter knows.

    The filter travels with the lines: each part of a shard's lines begins with it.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    first = filters.select(
        "shard", salts, F.lit(0).alias("turn"), F.lit(None).cast("long").alias("doc_id"),
        F.col("slots").alias("key"), "full",
    )
    salt = F.pmod(F.xxhash64("key", F.coalesce("doc_id", F.lit(-1))), F.lit(SALTS)).cast("int")
    lines = holdings.select(
        _shard(shards).alias("shard"), salt.alias("salt"), F.lit(1).alias("turn"), "doc_id",
        "key", F.lit(False).alias("full"),
    )
    order = ["shard", "salt"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: CuckooFilter | None = None
        at: tuple | None = None
        for batch in batches:
            shard, salt, turn = (batch.column(i).to_numpy() for i in range(3))
            bounds = np.flatnonzero(
                np.r_[True, (np.diff(shard) != 0) | (np.diff(salt) != 0), True]
            )
            for low, high in zip(bounds, bounds[1:], strict=False):
                if at != (shard[low], salt[low]):
                    at, known = (shard[low], salt[low]), None
                if turn[low] == 0:
                    known = CuckooFilter(
                        batch.column(4)[int(low)].as_py(), full=batch.column(5)[int(low)].as_py()
                    )
                    low += 1
                if known is None or low == high:
                    continue
                part = batch.slice(int(low), int(high - low))
                hit = known.has(CuckooFilter.hashes(part.column(4).to_pylist()))
                if hit.any():
                    yield part.select(["doc_id", "key"]).filter(pa.array(hit))

    return (
        first.unionByName(lines)
        .repartition(*order)
        .sortWithinPartitions(*order, "turn")
        .mapInArrow(probe, "doc_id long, key binary")
    )


def kept_lines(docs: DataFrame, state: LineState) -> DataFrame:
    """Rows, hidden, beside doc_id, n_lines, n_dropped and kept, the text of lines that stay.

    ``docs`` are documents that the state covers.  A null or empty text is one empty line.
    A shared line stays in the first document that holds it, each time it stands there.
    Rows that repeat a doc_id count as that document; rows without doc_id count together
    as a document after all others.  No row goes; no other column is read or renamed.
    """
    maybe = filtered(state.holdings, state.filters, state.shards)
    drops = (
        maybe.join(state.counts, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .select("doc_id", "key")
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.collect_set("key").alias("drops"))
    )
    rows = hidden(
        docs, doc_id=F.col("doc_id").cast("long"), _text=F.col("text").cast("string")
    )
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")

    @F.pandas_udf("struct<n_lines: long, n_dropped: long, kept: string>")
    def kept(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gone in zip(texts, drops, strict=True):
            lines = (text or "").split("\n")
            stay = lines
            if gone is not None and len(gone):
                gone = {bytes(x) for x in gone}
                stay = [x for x in lines if line_key(x.encode("utf-8", "surrogatepass")) not in gone]
            rows.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

    return joined.withColumn("_kept", kept("_text", "drops")).select(
        *[F.col(f"`{c}`") for c in rows.columns if c != "_text"], "_kept.*"
    )


def without_shared_lines(docs: DataFrame) -> DataFrame:
    """Documents, all columns, whose text has lost shared lines; a null text stays null."""
    rows = kept_lines(docs, started(docs))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("__text"))
    rows = rows.withColumn("__text", text)
    return rows.select(*shown(rows))
