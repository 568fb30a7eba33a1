"""Collocations by dynamic itemset counting.

Texts are dealt to shards, which are read in a cycle, one a step.  Words are counted from
the first step on.  After each step the phrases whose running count has reached the
threshold are marked; a longer phrase becomes active in the step after both the phrase
without its last and the one without its first word were marked, and is counted from there
until it has met every shard once.  Lengths therefore interleave: while rare words are still
in their first cycle, phrases of frequent ones are counted already.  Running counts go by
the phrases' hashes, as most phrases turn out rare; a last reading of the texts spells those
whose hash was frequent and counts them as they are spelled.

Marks travel to tasks as one table of fixed size for each length: a cell for each value of
a hash, holding the first step in which a phrase of that cell was marked.  Phrases that
share a cell may become active too early, which costs time only: when a phrase is active
depends on the table alone and never changes, so it is counted over exactly one cycle.  What
the last reading spells needlessly, because a hash or a cell is shared, is below the
threshold and left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.llm.common import (
    LOWER,
    UPPER,
    remove_folder,
    scratch_folder,
    slices,
    text_of,
    written,
)

#: What ends a piece, what parts words.
PIECE_END, BLANK = b".,;:!?\n\v\f\r", b" \t"
UNKNOWN = "und"
#: With more shards longer phrases start earlier, but running counts are merged more often.
SHARDS = 2
LONGEST, LEAST = 3, 10
#: A phrase inside a longer one is dropped if the longer one makes this share of it, in
#: hundredths.
MOST_INSIDE = 50
SCORE_UNITS = 1_000_000
MOST_PHRASES = 2000
#: Cells of a table of marks; a cell is a byte.  The table of frequent phrases has as many
#: bytes, each of eight cells.
CELLS = 1 << 23
NEVER = 255
#: Bytes of texts that a task splits at once, and words that it counts.
TEXT_AT_ONCE, WORDS_AT_ONCE = 1 << 21, 1 << 19
COUNTS = "size int, act int, key long, n long"
SPELLED = "lang string, size int, phrase string, n long"
#: A number for each byte and what the places of a word weigh, in a word's hash.
_NUMBERS = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_WEIGHT = 0x9E3779B97F4A7C15
#: Bytes of one of Spark's bitmaps.
_BITMAP = 4096
#: What a byte is: of a word, a blank or an end of a piece; and the byte in lower case.
_KIND, _LOWERED = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[list(BLANK)], _KIND[list(PIECE_END)] = 1, 2
_LOWERED[list(UPPER.encode())] = list(LOWER.encode())


def sharded_texts(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, text, shard): texts dealt to shards."""
    shard = F.pmod(F.xxhash64("text", F.spark_partition_id()), F.lit(shards)).cast("int")
    return (
        docs.select(
            F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
            text_of("text").alias("text"),
        )
        .filter("text != ''")
        .select("lang", "text", shard.alias("shard"))
    )


# --- marks ---------------------------------------------------------------------------------


def _turned(h: np.ndarray) -> np.ndarray:
    """A phrase's hash is its words' hashes, turned by 7 bits and combined one after another."""
    return (h << np.uint64(7)) | (h >> np.uint64(57))


class Marks:
    """For each length below the longest, the first step that marked a cell."""

    def __init__(self, longest: int, cells: int):
        self.cells = cells
        self.steps = {k: np.full(cells, NEVER, np.uint8) for k in range(1, longest)}

    def add(self, step: int, found: list) -> bool:
        """Take the cells marked in a step, as bitmaps; whether one of them is new."""
        new = False
        for row in found:
            bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
            at = (row.bucket - 1) * len(bits) + np.flatnonzero(bits)
            table = self.steps[row.size]
            at = at[table[at] == NEVER]
            table[at] = step
            new |= bool(len(at))
        return new


class Frequent:
    """For each length, a bit for each cell that holds a frequent phrase."""

    def __init__(self, longest: int, cells: int):
        self.cells = 8 * cells
        self.bits = {k: np.zeros(-(-cells // _BITMAP) * _BITMAP, np.uint8) for k in range(1, longest + 1)}

    def add(self, found: list) -> None:
        for row in found:
            bits = np.frombuffer(row.bits, np.uint8)
            self.bits[row.size][(row.bucket - 1) * len(bits) :][: len(bits)] |= bits

    def holds(self, size: int, hashed: np.ndarray) -> np.ndarray:
        cell = hashed & np.uint64(self.cells - 1)
        byte = self.bits[size][(cell >> np.uint64(3)).astype(np.int64)]
        return ((byte >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def marked_cells(counts: DataFrame, least: int, longest: int, cells: int) -> list:
    """Cells of the phrases shorter than ``longest`` that have reached the threshold, as at
    most ``cells`` bits a length."""
    reached = counts.filter((F.col("n") >= least) & (F.col("size") < longest))
    # positions in a bitmap count from 1
    cell = F.col("key").bitwiseAND(F.lit(cells - 1)) + 1
    return (
        reached.select("size", cell.alias("cell"))
        .groupBy("size", F.bitmap_bucket_number("cell").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
        .collect()
    )


# --- one step: a shard's active phrases ------------------------------------------------------


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of texts, and for each the number of its piece."""
    # the line end keeps texts apart
    whole = pc.binary_join_element_wise(texts, "\n", "").cast(pa.large_string())
    ends = np.frombuffer(whole.buffers()[1], np.int64)[[whole.offset, whole.offset + len(whole)]]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[1]]
    kind = _KIND[data]
    inside = kind == 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    # where words start and pieces end
    at = np.flatnonzero(starts | (kind == 2))
    word = kind[at] == 0
    piece = np.cumsum(~word)[word]
    at = at[word]
    # a word ends before the last byte, which is a line end
    stops = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    offsets = np.r_[0, np.cumsum(stops - at)].astype(np.int32)
    letters = pa.py_buffer(_LOWERED[data[inside]])
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), letters), piece


def _hashes(words: pa.Array, lang: str) -> np.ndarray:
    """A hash of each word in its language: its bytes' numbers, weighed by place and mixed."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1]
    sizes = np.diff(offsets)
    starts = (offsets[:-1] - offsets[0]).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    weights = np.cumprod(np.full(sizes.max(), _WEIGHT, np.uint64))
    h = _NUMBERS[data]
    h *= weights[np.arange(len(data)) - np.repeat(starts, sizes)]
    h = np.add.reduceat(h, starts) + np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _numbered(words: pa.Array, lang: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word's number, the different words, and their hashes."""
    coded = words.dictionary_encode()
    different = coded.dictionary
    return coded.indices.to_numpy().astype(np.int64), different, _hashes(different, lang)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of each (left, right) among the different ones."""
    coded = pa.array((left << np.int64(32)) | right).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64)


def _next_in_piece(at: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Of places in order, numbers of those whose next word is a place too, in the same piece."""
    return np.flatnonzero((at[1:] == at[:-1] + 1) & (piece[at[1:]] == piece[at[:-1]]))


def _counted(
    lang: str, words: pa.Array, piece: np.ndarray, first: int, marks: Marks, step: int,
    shards: int, longest: int,
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that start in ``words`` before place ``first`` and are active."""
    hashes = _hashes(words, lang)

    def out(size: int, act: int, counted: np.ndarray) -> pa.RecordBatch:
        """Rows of the hashes of phrases."""
        coded = pa.array(counted).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy())
        columns = [
            pa.array(np.full(len(n), size, np.int32)), pa.array(np.full(len(n), act, np.int32)),
            pa.array(coded.dictionary.to_numpy().view(np.int64)), pa.array(n.astype(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["size", "act", "key", "n"])

    if step < shards:
        yield out(1, 0, hashes[:first])
    # places where a phrase of the length before starts, and its hash there
    at = np.arange(len(hashes))
    hashed, act = hashes, np.zeros(len(at), np.uint8)
    for size in range(2, longest + 1):
        table, mask = marks.steps[size - 1], np.uint64(marks.cells - 1)
        # no phrase is marked before it is active, though its cell may be
        since = np.maximum(table[(hashed & mask).astype(np.int64)], act)
        # the phrase that starts one word on in the piece, if there is one
        adjacent = _next_in_piece(at, piece)
        marked = (since[adjacent] != NEVER) & (since[adjacent + 1] != NEVER)
        here = adjacent[marked]
        act = np.maximum(since[here], since[here + 1]) + 1
        started = act <= step
        here, act = here[started], act[started]
        # longer phrases need those whose cycle is over, too
        hashed = _turned(hashed[here]) ^ hashes[at[here] + size - 1]
        at = at[here]
        counted = (act > step - shards) & (at < first)
        # hashes may be shared, so phrases that became active in different steps stay apart
        for began in np.flatnonzero(np.bincount(act[counted])):
            yield out(size, int(began), hashed[counted & (act == began)])


def _spelled(
    lang: str, words: pa.Array, piece: np.ndarray, first: int, frequent: Frequent, longest: int
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases before place ``first`` in frequent cells, and of all words."""
    codes, different, hashes = _numbered(words, lang)

    def out(size: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        columns = [
            pa.repeat(lang, len(n)), pa.array(np.full(len(n), size, np.int32)), phrases,
            pa.array(n.astype(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "n"])

    yield out(0, pa.array([""]), np.array([min(first, len(codes))]))
    # places where a frequent phrase starts, its number and hash there
    at, number, hashed = np.arange(len(codes)), codes, hashes[codes]
    for size in range(1, longest + 1):
        if size > 1:
            here = _next_in_piece(at, piece)
            last = codes[at[here] + size - 1]
            at, number = at[here], _pairs(number[here], last)
            hashed = _turned(hashed[here]) ^ hashes[last]
        kept = frequent.holds(size, hashed)
        at, number, hashed = at[kept], number[kept], hashed[kept]
        if not len(at):
            return
        place = np.zeros(number.max() + 1, np.int64)
        place[number] = at
        n = np.bincount(number[at < first], minlength=len(place))
        held = np.flatnonzero(n)
        parts = [different.take(pa.array(codes[place[held] + k])) for k in range(size)]
        yield out(size, pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0], n[held])


def _in_parts(count, longest: int):
    """What ``count`` makes of the texts' words, WORDS_AT_ONCE at a time."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # freed memory goes back at once, as several workers share an executor
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.column("text").filter(pc.equal(batch.column("lang"), lang))
                for low, high in slices(pc.binary_length(own).to_numpy(), TEXT_AT_ONCE):
                    words, piece = _split(own.slice(low, high - low))
                    for start in range(0, len(words), WORDS_AT_ONCE):
                        some = slice(start, start + WORDS_AT_ONCE + longest - 1)
                        yield from count(lang, words[some], piece[some], WORDS_AT_ONCE)

    return parts


def _step(marks, step: int, shards: int, longest: int):
    """Counts of one shard's texts."""
    return _in_parts(lambda *part: _counted(*part, marks.value, step, shards, longest), longest)


def _last(frequent, longest: int):
    """Counts of frequent phrases, spelled."""
    return _in_parts(lambda *part: _spelled(*part, frequent.value, longest), longest)


def phrase_counts(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    shards: int = SHARDS,
    cells: int = CELLS,
) -> DataFrame:
    """(lang, size, phrase, n): all words and phrases found ``least`` times or more, and for
    each language a row of size 0 with the number of all words.

    ``longest`` * ``shards`` steps at most.  A step adds its shard's counts to those of the
    phrases still in their cycle, in a table in the shared folder; what ends its cycle leaves,
    rare phrases at once.
    """
    spark = docs.sparkSession
    folder, scratch = scratch_folder(spark, "phrases"), scratch_folder(spark, "phrases-steps")
    texts = written(sharded_texts(docs, shards), f"{scratch}/texts", "shard")
    marks, last_new, step = Marks(longest, cells), 0, 0
    frequent = Frequent(longest, cells)
    running = spark.createDataFrame([], COUNTS)
    while step < shards or step <= last_new + shards:
        sent = spark.sparkContext.broadcast(marks)
        here = texts.filter(F.col("shard") == step % shards).select("lang", "text")
        new = here.mapInArrow(_step(sent, step, shards, longest), COUNTS)
        goes_on = F.col("act") > step - shards + 1
        counts = written(
            running.unionByName(new)
            .groupBy("size", "act", "key")
            .agg(F.sum("n").alias("n"))
            .filter(goes_on | (F.col("n") >= least)),
            f"{scratch}/counts-{step}",
        )
        if marks.add(step, marked_cells(counts, least, longest, cells)):
            last_new = step
        sent.destroy()
        if step >= shards - 1:
            frequent.add(marked_cells(counts.filter(~goes_on), least, longest + 1, frequent.cells))
        if step:
            remove_folder(spark, f"{scratch}/counts-{step - 1}")
        running = counts.filter(goes_on)
        step += 1
    sent = spark.sparkContext.broadcast(frequent)
    spelled = texts.select("lang", "text").mapInArrow(_last(sent, longest), SPELLED)
    done = written(
        spelled.groupBy("lang", "size", "phrase")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("size") == 0) | (F.col("n") >= least)),
        f"{folder}/counts",
    )
    sent.destroy()
    remove_folder(spark, scratch)
    return done


# --- collocations ------------------------------------------------------------------------------


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored_phrases(counts: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, l, r, score): each phrase of two words or more, cut where it
    holds together least."""
    phrases = counts.filter("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    cuts = phrases.withColumn("cut", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "lang", "size", "phrase", "a", "cut",
        _joined(words, F.lit(1), F.col("cut")).alias("left"),
        _joined(words, F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"),
    )
    parts = counts.filter("size >= 1")
    of = lambda side, name: parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    over = (big("a") * big("a")).cast("decimal(31,0)") * F.lit(SCORE_UNITS).cast("decimal(7,0)")
    score = F.call_function("div", over, (big("l") * big("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", score)
    least = F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "cut"))
    return cuts.groupBy("lang", "size", "phrase").agg(least.alias("cut")).select(
        "lang", "size", "phrase", "cut.a", "cut.l", "cut.r", "cut.score"
    )


def outside_longer(phrases: DataFrame, longest: int, most_inside: int) -> DataFrame:
    """Phrases that no longer one, dropped or not, makes up by ``most_inside`` hundredths."""
    words = F.split("phrase", " ", -1)
    starts = F.explode(F.expr("sequence(1, size)"))
    inner = (
        phrases.filter("size > 2")
        .select("lang", "size", words.alias("words"), "a", starts.alias("start"))
        .withColumn("length", F.explode(F.expr("sequence(1, size - 1)")))
        .filter("length >= 2 AND start + length - 1 <= size")
        .select("lang", _joined(F.col("words"), F.col("start"), F.col("length")).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    held = phrases.join(inner, ["lang", "phrase"], "left")
    outside = F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * most_inside)
    return held.filter(outside).drop("longer")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    most_inside: int = MOST_INSIDE,
    most: int = MOST_PHRASES,
    shards: int = SHARDS,
    cells: int = CELLS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases.

    ``docs`` has text and lang.  Phrases lie inside a piece: they pass neither a stop nor a
    line end, nor from one text to the next.  A null text is empty, a null language ``und``,
    together with rows of that name.  Repeated rows count each; texts of any length are
    counted whole, in parts that overlap by a phrase.  Of equal scores the more frequent
    phrase comes first, then the one that sorts first in UTF-8 bytes.  A table without words
    gives no rows.  No column but text and lang is read.
    """
    counts = phrase_counts(docs, least, longest, shards, cells)
    kept = outside_longer(scored_phrases(counts), longest, most_inside)
    totals = counts.filter("size = 0").select("lang", "n")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
