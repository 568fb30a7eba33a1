"""Byte-level BPE with the ranks of a public vocabulary.

Texts are split by the vocabulary's pattern.  Frequent words are encoded once for the corpus
by higher-order functions: the bytes of a word are an array of pieces, and a fold merges,
step by step, the neighbouring pair of the lowest rank, with ranks from a literal map.
Their number is bounded, so they may go to all tasks.  The other words are encoded once for
each block of documents, where the block is: words of one length are rows of a matrix of
pieces, and a step merges the pair of the lowest rank in every row.  Nothing but counts of
words is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.functions.text import CHARSET, let
from descry.llm.common import text_of
from descry.session import checkpointed

#: White space, as the pattern of the public vocabularies means it.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The pattern of public_tokenizers with white space spelled out, which Java has in ASCII only.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Parts of the rank map; a pair is compared with those of its part.
PARTS = 1 << 13
NO_RANK = 2**31 - 1
#: Bytes of a word that are merged at once; a longer word is merged stretch by stretch.
STRETCH = 64
#: Pieces before a stretch that are merged anew with it; where that is too few, the more.
REMERGED = (8, 64)
#: Bytes of a word that is merged beside others of its length, fewest words of a length for
#: that, and pieces in a matrix; other words are merged one by one.
LONGEST_ROW, FEWEST_ROWS, MATRIX = 128, 8, 1 << 18
#: Most words that go to all tasks, and the longest of them in bytes.
MOST_WORDS, LONGEST_WORD = 1 << 19, 64
#: Bytes that Spark hands to a Python worker at once: a session setting, lowered to this.
BATCH_BYTES = 1 << 22
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of words in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 1 << 22


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a piece in base64 and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Ranks:
    """The rank map as a literal, in parts by the pieces' checksums.

    Strings have one character for each byte.
    """

    def __init__(self, ranks: dict[bytes, int]):
        parts: list[dict[str, int]] = [{} for _ in range(PARTS)]
        for piece, rank in ranks.items():
            text = piece.decode(CHARSET)
            parts[zlib.crc32(text.encode()) % PARTS][text] = rank
        self.literal = F.from_json(F.lit(json.dumps(parts)), "array<map<string, int>>")
        self.merges = Merges(ranks)

    def encode(self, word: Column) -> Column:
        """Ids of a word: its own rank if it has one, else those of its merged pieces."""
        # bound once: each mention of the literal would be one more copy in the plan
        return let(self.literal, lambda table: _encoded(table, word))


def _rank_of(table: Column, piece: Column) -> Column:
    """Rank of a piece, null if it has none."""
    part = F.element_at(table, (F.crc32(piece) % PARTS + 1).cast("int"))
    return F.try_element_at(part, piece)


def _encoded(table: Column, word: Column) -> Column:
    def encoded(raw: Column) -> Column:
        return let(
            _rank_of(table, raw),
            lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(
                F.transform(pieces(raw), lambda x: _rank_of(table, x))
            ),
        )

    def pieces(raw: Column) -> Column:
        short = F.char_length(raw) <= STRETCH
        return F.when(short, _merged(table, raw)).otherwise(_merged_long(table, raw))

    return let(F.decode(F.encode(word, "UTF-8"), CHARSET), encoded)


def _merged(table: Column, raw: Column) -> Column:
    """Pieces of some bytes after all merges, one merge a step."""

    def rank(a: Column, b: Column) -> Column:
        """Rank of two pieces as one; none where one is missing."""
        return F.coalesce(_rank_of(table, F.concat(a, b)), F.lit(NO_RANK))

    def fold(pieces: Column) -> Column:
        # the rank of each piece with the next
        ranks = F.transform(pieces, lambda x, i: rank(x, F.get(pieces, i + 1)))
        return F.aggregate(
            F.sequence(F.lit(2), F.char_length(raw)),
            F.struct(pieces.alias("pieces"), ranks.alias("ranks")),
            lambda s, _: step(s["pieces"], s["ranks"], s),
            lambda s: s["pieces"],
        )

    def step(pieces: Column, ranks: Column, s: Column) -> Column:
        """One merge: the first pair of the lowest rank; nothing once no pair has a rank."""

        def merge(at: Column) -> Column:
            pair = F.concat(pieces[at - 1], pieces[at])
            joined = F.transform(pieces, lambda x, i: F.when(i == at - 1, pair).when(i != at, x))
            before = rank(F.get(pieces, at - 2), pair)
            after = rank(pair, F.get(pieces, at + 1))
            anew = F.transform(
                ranks,
                lambda x, i: F.when(i == at - 2, before)
                .when(i == at - 1, after)
                .when(i != at, x),
            )
            present = lambda x: x.isNotNull()
            return F.struct(
                F.filter(joined, present).alias("pieces"), F.filter(anew, present).alias("ranks")
            )

        return let(
            F.array_min(ranks),
            lambda low: F.when(low == NO_RANK, s).otherwise(
                let(F.array_position(ranks, low).cast("int"), merge)
            ),
        )

    pieces = F.filter(F.split(raw, ""), lambda x: x != "")
    return F.when(F.char_length(raw) > 1, let(pieces, fold)).otherwise(pieces)


def _merged_long(table: Column, raw: Column) -> Column:
    """Merged pieces of a long word, in time that grows with its length.

    Pieces are a word's encoding if each two neighbours are that of their bytes: the first
    merge over a border between them would be the first over it in the two alone.  So when
    a stretch is added, only some of the last pieces are merged anew with it, and the rest
    stand if the first of those comes out as it was.  If it doesn't, more are, at last all.
    """
    state = "struct<done: array<array<string>>, tail: array<string>>"
    attempt = "struct<head: array<string>, pieces: array<string>, all: boolean>"

    def extended(s: Column, stretch: Column) -> Column:
        def tried(found: Column, most: Column) -> Column:
            every = most == NO_RANK
            known = F.when(every, F.concat(F.flatten(s["done"]), s["tail"])).otherwise(s["tail"])
            return F.when(found.isNotNull(), found).otherwise(
                let(known, lambda k: anew(k, F.greatest(F.size(k) - most, F.lit(0)), every))
            )

        def anew(known: Column, kept: Column, every: Column) -> Column:
            again = F.slice(known, kept + 1, F.size(known))
            pieces = _merged(table, F.concat(F.array_join(again, ""), stretch))
            stands = lambda x: every | (F.size(again) == 0) | (F.get(x, F.lit(0)) == F.get(again, F.lit(0)))
            head = F.slice(known, F.lit(1), kept)
            return let(
                pieces, lambda x: F.when(stands(x), F.struct(head, x, every).cast(attempt))
            )

        def moved(found: Column) -> Column:
            """The state after a stretch: what no merge will look at goes to ``done``."""
            done = F.when(found["all"], F.array().cast("array<array<string>>")).otherwise(s["done"])

            def split(tail: Column) -> Column:
                cut = F.size(tail) - max(REMERGED)
                many = F.size(tail) > 2 * max(REMERGED)
                past = F.concat(done, F.array(F.slice(tail, F.lit(1), cut)))
                return F.when(
                    many, F.struct(past, F.slice(tail, cut + 1, F.size(tail))).cast(state)
                ).otherwise(F.struct(done, tail).cast(state))

            return let(F.concat(found["head"], found["pieces"]), split)

        tries = F.array(*[F.lit(k) for k in (*REMERGED, NO_RANK)])
        return let(F.aggregate(tries, F.lit(None).cast(attempt), tried), moved)

    empty = F.struct(F.array().alias("done"), F.array().alias("tail")).cast(state)
    stretches = F.regexp_extract_all(raw, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    return F.aggregate(
        stretches, empty, extended, lambda s: F.concat(F.flatten(s["done"]), s["tail"])
    )


def words_of_text(text: Column) -> Column:
    """The matches of the pattern, which together are the whole text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def frequent_words(docs: DataFrame, ranks: Ranks) -> DataFrame:
    """(word, ids) of the corpus's frequent words, MOST_WORDS at most.

    Counts cover all texts.  The least count is the least power of two that few enough
    words reach, so it shows only in how often a word is encoded.
    """
    words = docs.select(F.explode(words_of_text(text_of("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    counts = checkpointed(counts.where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST_WORD)))
    power = F.floor(F.log2("n")).cast("int").alias("power")
    sizes = {r["power"]: r["count"] for r in counts.groupBy(power).count().collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least > 1 and total + sizes.get(least - 1, 0) <= MOST_WORDS:
        least -= 1
        total += sizes.get(least, 0)
    frequent = counts.where(F.col("n") >= 1 << least).select("word")
    return frequent.select("word", ranks.encode(F.col("word")).alias("ids"))


class Merges:
    """The ranks for many words at once, inside a task.

    A piece goes by its rank, a byte without one by a number below zero.
    """

    def __init__(self, ranks: dict[bytes, int]):
        own = {bytes([b]): -1 - b for b in range(256)} | ranks
        rows = [
            (own[piece[:k]], own[piece[k:]], rank)
            for piece, rank in ranks.items()
            for k in range(1, len(piece))
            if piece[:k] in own and piece[k:] in own
        ]
        left, right, rank = np.array(rows or [(0, 0, NO_RANK)], np.int64).T
        key = self._key(left, right)
        order = np.argsort(key)
        self.ranks, self.keys, self.found = ranks, key[order], rank[order].astype(np.int32)
        self.of_byte = np.array([own[bytes([b])] for b in range(256)], np.int32)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)

    def _of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], np.int32(NO_RANK))

    def _rows(self, pieces: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and their pieces after all merges, of words of one length.

        Each step is one merge in each row: the first pair of the lowest rank.  A row that
        has none leaves, so the others have one number of pieces.
        """
        rows = np.arange(len(pieces))
        ranks = self._of_pairs(pieces[:, :-1], pieces[:, 1:])
        while len(rows) and ranks.shape[1]:
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), at]
            ended = low == NO_RANK
            if ended.any():
                yield rows[ended], pieces[ended]
                rows, pieces, ranks = rows[~ended], pieces[~ended], ranks[~ended]
                at, low = at[~ended], low[~ended]
            n, size = pieces.shape
            each = np.arange(n)
            pieces[each, at] = low
            pieces = pieces[np.arange(size) != at[:, None] + 1].reshape(n, size - 1)
            ranks = ranks[np.arange(size - 1) != at[:, None]].reshape(n, size - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < size - 2)
            ranks[before, at[before] - 1] = self._of_pairs(pieces[before, at[before] - 1], low[before])
            ranks[after, at[after]] = self._of_pairs(low[after], pieces[after, at[after] + 1])
        if len(rows):
            yield rows, pieces

    def _one(self, word: bytes) -> list[int]:
        """Pieces of a word after all merges: pairs wait in a heap, so time is n log n."""
        size, rank_of = len(word), self.ranks.get
        # ends of pieces by their starts, starts by their ends, ranks of pieces with the next
        end, start = list(range(1, size + 1)), list(range(-1, size))
        pair = [rank_of(word[i : i + 2], NO_RANK) for i in range(size - 1)] + [NO_RANK]
        heap = [(rank, i) for i, rank in enumerate(pair) if rank != NO_RANK]
        heapq.heapify(heap)
        own = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        while heap:
            rank, i = heapq.heappop(heap)
            if pair[i] != rank:
                continue
            own[i], pair[end[i]], end[i] = rank, NO_RANK, end[end[i]]
            start[end[i]] = i
            for k in (start[i], i) if i else (i,):
                after = end[end[k]] if end[k] < size else 0
                pair[k] = rank_of(word[k:after], NO_RANK) if after else NO_RANK
                if pair[k] != NO_RANK:
                    heapq.heappush(heap, (pair[k], k))
        found, i = [], 0
        while i < size:
            found.append(own[i])
            i = end[i]
        return found

    def encoded(self, words: pa.Array) -> pa.ListArray:
        """Ids of words: a word's own rank if it has one, else those of its merged pieces."""
        if not len(words):
            return pa.array([], pa.list_(pa.int32()))
        raw = words.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        known = pa.array(list(self.ranks), pa.large_binary())
        own = pc.index_in(raw, value_set=known).fill_null(-1).to_numpy()
        whole = np.flatnonzero(own >= 0)
        values = np.fromiter(self.ranks.values(), np.int32, len(self.ranks))
        # ids as they are found, and the words they belong to
        words_of, ids = [whole], [values[own[whole]]]

        def add(numbers: np.ndarray, pieces: np.ndarray) -> None:
            words_of.append(np.repeat(numbers, pieces.shape[1]))
            ids.append(pieces.reshape(-1))

        others = np.flatnonzero((own < 0) & (sizes > 0))
        others = others[np.argsort(sizes[others], kind="stable")]
        lengths, starts = np.unique(sizes[others], return_index=True)
        for size, alike in zip(lengths.tolist(), np.split(others, starts[1:]), strict=False):
            if size > LONGEST_ROW or len(alike) < FEWEST_ROWS:
                for k in alike:
                    low = int(offsets[k])
                    add(np.array([k]), np.array([self._one(data[low : low + size].tobytes())], np.int32))
                continue
            for part in np.array_split(alike, -(-len(alike) * size // MATRIX)):
                pieces = self.of_byte[data[offsets[part][:, None] + np.arange(size)]]
                for rows, merged in self._rows(pieces):
                    add(part[rows], merged)
        word, flat = np.concatenate(words_of), np.concatenate(ids)
        flat = flat[np.argsort(word, kind="stable")]
        ends = np.r_[0, np.cumsum(np.bincount(word, minlength=len(raw)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=flat < 0))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else column.combine_chunks()


def _written(column: pa.ChunkedArray) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"x": column})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(written: bytes) -> pa.Array:
    return _whole(pa.ipc.open_stream(written).read_all().column("x"))


def _frugal() -> None:
    """Let Arrow give freed memory back at once: several workers share an executor."""
    pa.set_memory_pool(pa.system_memory_pool())


def _ids_of_documents(doc_ids: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, ids], ["doc_id", "ids"])


def _blocks(frequent: bytes, frequent_ids: bytes, merges: Merges, finish):
    """Documents' ids from the ids of frequent words and those of the block's others."""

    def block(part: pa.RecordBatch, known: pa.Array, known_ids: pa.Array) -> pa.RecordBatch:
        doc_ids, lists = part.columns
        ends = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten()
        codes = pc.index_in(words, value_set=known)
        other = codes.is_null()
        rest = words.filter(other).dictionary_encode()
        numbers = codes.fill_null(0).to_numpy().astype(np.int32)
        numbers[other.to_numpy(zero_copy_only=False)] = rest.indices.to_numpy() + len(known)
        ids = pa.concat_arrays([known_ids, merges.encoded(rest.dictionary)])
        taken = ids.take(pa.array(numbers))
        del ids
        at = taken.offsets.to_numpy()[ends - ends[0]]
        return finish(doc_ids, pa.ListArray.from_arrays(pa.array(at), taken.values))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _frugal()
        known, known_ids = _read(frequent), _read(frequent_ids).cast(pa.list_(pa.int32()))
        for batch in batches:
            # cut where the words of documents pass the size of a block
            lists = batch.column(1)
            sizes = pc.binary_length(lists.flatten()).to_numpy().astype(np.int64)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = np.r_[0, np.cumsum(sizes)][ends] // BLOCK_BYTES
            cuts = np.r_[0, np.flatnonzero(np.diff(at[1:])) + 1, batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low < high:
                    yield block(batch.slice(int(low), int(high - low)), known, known_ids)

    return blocks


def encoded_documents(
    docs: DataFrame,
    ranks: Ranks,
    finish=_ids_of_documents,
    schema: str = "doc_id long, ids array<int>",
) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, without special tokens.

    A null or empty text has no ids.  Each match of the pattern is encoded by itself.
    Repeated rows give repeated rows; no column but doc_id and text is read.  ``finish``
    makes other columns of the ids where they stand, such as digests.  The session's limit
    for the bytes of an Arrow batch stays lowered to BATCH_BYTES.
    """
    # documents' words are long rows: by number alone, batches would take a worker's memory
    docs.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    frequent = frequent_words(docs, ranks).toArrow()
    words, ids = _written(frequent.column("word")), _written(frequent.column("ids"))
    del frequent
    split = docs.select(
        F.col("doc_id").cast("long"), words_of_text(text_of("text")).alias("words")
    )
    return split.mapInArrow(_blocks(words, ids, ranks.merges, finish), schema)


def decode(ids: Column, pieces: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces, concatenated; null for an unknown id."""
    by_id = {str(rank): piece.decode(CHARSET) for piece, rank in pieces.items()}
    order = [by_id.get(str(i)) for i in range(max(pieces.values()) + 1)]
    literal = F.from_json(F.lit(json.dumps(order)), "array<string>")
    found = F.transform(ids, lambda i: F.get(literal, i))
    whole = F.forall(found, lambda x: x.isNotNull())
    return F.when(whole, F.encode(F.array_join(found, ""), CHARSET))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(pieces: dict[bytes, int]):
    """A finish: the number of ids, the digest of the decimal ids joined by blanks, and the
    digest of the bytes that the ids decode to, their pieces one after the other."""
    order = [b""] * (max(pieces.values()) + 1)
    for piece, rank in pieces.items():
        order[rank] = piece
    tables = (pa.array([b"%d " % i for i in range(len(order))], pa.large_binary()), 1), (
        pa.array(order, pa.large_binary()),
        0,
    )

    def hashes(table: pa.Array, last: int, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        # what is taken lies in one buffer, so a document's bytes are a slice of it
        taken = table.take(ids)
        at = np.frombuffer(taken.buffers()[1] or bytes(8), np.int64)[ends].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        cuts = zip(at, at[1:], strict=False)
        return pa.array([hashlib.sha256(data[a : max(a, b - last)]).hexdigest() for a, b in cuts])

    def digest(doc_ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        ends = lists.offsets.to_numpy().astype(np.int64)
        found = [hashes(table, last, lists.values, ends) for table, last in tables]
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(np.diff(ends)), *found],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return digest


def digested_documents(docs: DataFrame, pieces: dict[bytes, int]) -> DataFrame:
    """Documents encoded and decoded, as digests."""
    return encoded_documents(docs, Ranks(pieces), digests(pieces), DIGESTS)
