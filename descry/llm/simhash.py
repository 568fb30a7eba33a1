"""Near-duplicate documents by SimHash fingerprints and bit-sliced comparison.

A fingerprint has a bit for each position of a hash, set where more than half of the
hashes of the text's word shingles have it.  Keys are some of its bits, and fingerprints
with an equal key meet in a bucket.  There they stand vertically, one bit plane for each
position: a shift of the planes compares every row with the one so many rows on,
carry-save counters add up the differing planes of 64 rows with one operation, and a block
of rows is abandoned as soon as all of its counters have passed the radius.

A scheme with a similarity takes what fingerprints link as candidates only: texts that
candidates connect are compared by their shingles, and only those links count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.llm.common import hidden, shown
from descry.llm.components import connected_components, joined_labels
from descry.session import checkpointed

SEED = 42
#: Most rows, on average, of one side of a compared pair of chunks of a bucket.
CHUNK = 4096
#: Most texts, on average, of one side of a compared pair of chunks of candidates.
TEXTS = 512
#: Shingles hashed at once, lanes compared at once: bounds on memory only.
HASHES_AT_ONCE = 1 << 15
LANES_AT_ONCE = 1 << 16
PLANES_AT_ONCE = 8


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, bits of a fingerprint (a multiple of 64), the most bits in which
    linked fingerprints differ, and for each bucket key the positions of its bits.

    With a similarity, radius is only what fingerprints alone would go by: texts within
    ``reach`` are candidates, and those with the Jaccard similarity are linked."""

    shingle: int
    bits: int
    radius: int
    keys: tuple[tuple[int, ...], ...]
    similarity: float | None = None
    reach: int = 0


def exact_scheme(shingle: int, radius: int, bits: int = 64) -> Scheme:
    """Finds all pairs: of radius + 2 blocks of bits at least two have no difference."""
    edges = [round(i * bits / (radius + 2)) for i in range(radius + 3)]
    blocks = [tuple(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return Scheme(shingle, bits, radius, tuple(a + b for a, b in combinations(blocks, 2)))


def similarity_scheme(
    shingle: int = 5, similarity: float = 0.8, bits: int = 256, keys: int = 48, key_bits: int = 12
) -> Scheme:
    """Finds texts by the Jaccard similarity of their shingles; fingerprints give candidates.

    Vectors of a similarity j have the cosine 2j / (1 + j) or more, and the share of
    differing bits is their angle over pi.  The radius is one standard deviation above
    what is expected, the reach 4.5.  A random key is shared with a probability of
    (1 - share) to the number of its bits, and there are as many keys as miss 1 of 1000
    pairs at the similarity.  Texts of five shingles differ in more bits: of their pairs 2
    of 100 are missed, and less than 1 of 100 from ten shingles on.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    radius, reach = (
        int(bits * share + k * np.sqrt(bits * share * (1 - share))) for k in (1, 4.5)
    )
    rng = np.random.default_rng(SEED)
    chosen = [tuple(sorted(rng.choice(bits, key_bits, replace=False).tolist())) for _ in range(keys)]
    return Scheme(shingle, bits, radius, tuple(chosen), similarity, reach)


#: Shingles of three words, all pairs that differ in at most two of 64 bits.
CLOSE = exact_scheme(shingle=3, radius=2)
#: Shingles of five words, a similarity of 0.8 or more.
SIMILAR = similarity_scheme()


def _hashes(rows, bits: int) -> bytes:
    if bits == 64:
        return b"".join(xxhash.xxh64_digest(row, SEED)[::-1] for row in rows)
    hashed = []
    for row in rows:
        hashed += [xxhash.xxh3_128_digest(row, turn) for turn in range(bits // 128)]
    return b"".join(hashed)


def fingerprint(text: bytes | None, scheme: Scheme = CLOSE) -> bytes:
    """Fingerprint of a UTF-8 text, the highest bit first; null texts and texts without
    words have zero."""
    words, bits, shingle = (text or b"").lower().split(), scheme.bits, scheme.shingle
    if not words:
        return bytes(bits // 8)
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(bits, np.int64)
    for start in range(0, n, HASHES_AT_ONCE):
        stop = min(n, start + HASHES_AT_ONCE)
        if len(words) < shingle:
            rows = [words]
        else:
            columns = [words[start + k : stop + k] for k in range(shingle)]
            rows = zip(*columns, strict=False)
        hashed = _hashes(map(b" ".join, rows), bits)
        set_bits = np.unpackbits(
            np.frombuffer(hashed, np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little"
        )
        counts += set_bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()[::-1]


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles of a UTF-8 text; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    columns = [words[k:] for k in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    rows = map(b" ".join, zip(*columns, strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in rows), np.uint64))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes have the Jaccard similarity; two empty ones are equal."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    union = len(np.union1d(a, b))
    return union == 0 or (len(a) + len(b) - union) / union >= similarity


def _digest() -> Column:
    """Digest of a text; a null one counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def fingerprints(docs: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """(doc_id, fp, digest): the fingerprint and the digest of each whole text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py(), scheme) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary()), batch.column(2)],
                ["doc_id", "fp", "digest"],
            )

    texts = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), _digest().alias("digest")
    )
    return texts.mapInArrow(hashed, "doc_id long, fp binary, digest binary")


def _bits(prints: list[bytes], bits: int) -> np.ndarray:
    """(rows, bits) of zeros and ones, the lowest bit first."""
    rows = np.frombuffer(b"".join(prints), np.uint8).reshape(-1, bits // 8)
    return np.unpackbits(np.ascontiguousarray(rows[:, ::-1]), axis=1, bitorder="little")


def _keyed(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """(part, key, fp) for each bucket key of each fingerprint."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(batch.column(0).to_pylist(), scheme.bits)
            for part, places in enumerate(scheme.keys):
                weights = 1 << np.arange(len(places), dtype=np.int64)
                key = bits[:, places].astype(np.int64) @ weights
                parts = np.full(len(key), part, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts), pa.array(key), batch.column(0)], ["part", "key", "fp"]
                )

    return prints.select("fp").mapInArrow(keys, "part int, key long, fp binary")


def close_links(prints: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` of close pairs.

    A bucket with many fingerprints is dealt into chunks; each pair of chunks is a task's
    group, so no group grows with the bucket.  What leaves a comparison is a link for each
    fingerprint to the first that it is connected with there, not all of its pairs.
    """
    keyed = _keyed(prints, scheme)
    shared = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = keyed.join(shared, ["part", "key"]).withColumn(
        "chunks", F.ceil(F.col("n") / F.lit(CHUNK))
    )
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    )
    grouped = dealt.select(
        "part",
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "own",
        "fp",
    )
    order = ["part", "key", "i", "j"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _links_of_groups(batches, scheme)

    return (
        grouped.repartition(*order)
        .sortWithinPartitions(*order, "own", "fp")
        .mapInArrow(compared, "a binary, b binary")
    )


def _links_of_groups(
    batches: Iterator[pa.RecordBatch], scheme: Scheme
) -> Iterator[pa.RecordBatch]:
    """Complete groups of the sorted stream, as many as are at hand, compared together."""
    held: list[tuple[np.ndarray, list[bytes]]] = []

    def emitted(parts: list[tuple[np.ndarray, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        groups = np.concatenate([g for g, _ in parts])
        prints = [p for _, some in parts for p in some]
        for a, b in _connected(groups, prints, scheme):
            yield pa.RecordBatch.from_arrays(
                [pa.array([prints[x] for x in rows], pa.binary()) for rows in (a, b)], ["a", "b"]
            )

    for batch in batches:
        groups = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
        prints = batch.column(5).to_pylist()
        if not len(groups):
            continue
        last = np.flatnonzero((groups[:, :4] != groups[-1, :4]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        whole = bool(held) and bool((held[-1][0][-1, :4] != groups[0, :4]).any())
        if cut or whole:
            yield from emitted([*held, (groups[:cut], prints[:cut])])
            held = []
        held.append((groups[cut:], prints[cut:]))
    if held:
        yield from emitted(held)


def _connected(
    groups: np.ndarray, prints: list[bytes], scheme: Scheme
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts = np.flatnonzero(np.r_[True, (groups[1:, :4] != groups[:-1, :4]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(groups)])
    order = np.argsort(-sizes, kind="stable")
    lanes, taken = 0, []
    for g in order[sizes[order] > 1]:
        taken.append(g)
        lanes += sizes[g]
        if lanes >= LANES_AT_ONCE:
            yield _sliced(groups, prints, starts[taken], sizes[taken], scheme)
            lanes, taken = 0, []
    if taken:
        yield _sliced(groups, prints, starts[taken], sizes[taken], scheme)


def bit_planes(prints: list[bytes], bits: int) -> np.ndarray:
    """Bit i of all rows as row i, 64 rows to a word, with empty words at the end."""
    words = -(-len(prints) // 64)
    rows = np.zeros((words * 64, bits), np.uint8)
    rows[: len(prints)] = _bits(prints, bits)
    packed = np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little").view(np.uint64)
    return np.pad(packed, ((0, 0), (0, words + 2)))


def exceeding(planes: np.ndarray, shift: int, words: int, wanted: np.ndarray, radius: int):
    """Lanes whose row differs from the row ``shift`` on in more than ``radius`` bits.

    Lanes outside ``wanted`` are of no interest.  Counters start so high that they run
    over at radius + 1; once all wanted lanes have, the planes left are not read.
    """
    whole, rest = divmod(shift, 64)
    size = (radius + 1).bit_length()
    start = (1 << size) - (radius + 1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full(words, full if start >> k & 1 else 0, np.uint64) for k in range(size)]
    over = ~wanted
    for first in range(0, len(planes), PLANES_AT_ONCE):
        here = planes[first : first + PLANES_AT_ONCE]
        there = here[:, whole : whole + words] >> np.uint64(rest)
        if rest:
            there |= here[:, whole + 1 : whole + 1 + words] << np.uint64(64 - rest)
        there ^= here[:, :words]
        for carry in there:
            for k in range(size):
                carry, counters[k] = counters[k] & carry, counters[k] ^ carry
            over |= carry
        if (over == full).all():
            break
    return over


def _sliced(
    groups: np.ndarray,
    prints: list[bytes],
    starts: np.ndarray,
    sizes: np.ndarray,
    scheme: Scheme,
) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the first rows they are connected with; groups come with the largest first."""
    taken = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)])
    group = np.repeat(np.arange(len(sizes)), sizes)
    same, own = groups[taken, 2] == groups[taken, 3], groups[taken, 4]
    planes = bit_planes([prints[x] for x in taken], scheme.bits)
    label = np.arange(len(taken))
    ends = np.cumsum(sizes)
    for shift in range(1, int(sizes[0])):
        lanes = int(ends[np.count_nonzero(sizes > shift) - 1])
        reach = lanes - shift
        # two chunks of a bucket are compared with each other, one chunk with itself;
        # rows that are connected already need no further link
        wanted = (group[:reach] == group[shift:lanes]) & (
            same[:reach] | (own[:reach] != own[shift:lanes])
        )
        wanted &= label[:reach] != label[shift:lanes]
        if not wanted.any():
            continue
        words = -(-reach // 64)
        mask = np.zeros(words * 64, np.uint8)
        mask[:reach] = wanted
        mask = np.packbits(mask, bitorder="little").view(np.uint64)
        near = ~exceeding(planes, shift, words, mask, scheme.radius)
        at = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        if len(at):
            label = joined_labels(label, at, at + shift)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return taken[moved], taken[label[moved]]


def near_duplicates(docs: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other.  Repeated
    rows give repeated rows.  A null doc_id is never the smallest unless its component
    has no other; then component_id is null.  Other columns are not read.

    Equal fingerprints meet once only: candidates, links and components concern distinct
    fingerprints, and documents are joined to them at the end.
    """
    prints = checkpointed(fingerprints(docs, scheme).select("doc_id", "fp"))
    first = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(close_links(first, scheme))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def verified_links(docs: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) between digests of texts that have the scheme's similarity.

    ``texts`` are the different texts (digest, first doc_id, fp, root of candidates).
    Candidates with one root are dealt into chunks, and each pair of chunks is a task's
    group; there the shingles of texts whose fingerprints are within reach are
    compared, unless accepted links connect them already.
    """
    shared = texts.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    some = texts.join(shared, "root").withColumn("chunks", F.ceil(F.col("n") / F.lit(TEXTS)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.col("text").cast("string").alias("text"),
        _digest().alias("_digest"),
    )
    same = (F.col("digest") == F.col("_digest")) & F.col("first").eqNullSafe(F.col("id"))
    found = rows.join(some, same).groupBy("digest").agg(
        *[F.first(c).alias(c) for c in ("fp", "root", "chunks", "text")]
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(4).cast(pa.binary())
            sets = [shingle_hashes(t.as_py(), scheme.shingle).tobytes() for t in said]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sets, pa.binary())],
                ["digest", "fp", "root", "chunks", "shingles"],
            )

    sets = found.select("digest", "fp", "root", "chunks", "text").mapInArrow(
        hashed, "digest binary, fp binary, root binary, chunks long, shingles binary"
    )
    dealt = sets.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("chunks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    )
    grouped = dealt.select(
        "root",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "own",
        "digest",
        "fp",
        "shingles",
    )
    order = ["root", "i", "j"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for low, high in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if keys[low] != at:
                    if held:
                        yield _similar_links(pa.Table.from_batches(held), scheme)
                    at, held = keys[low], []
                held.append(batch.slice(low, high - low))
        if held:
            yield _similar_links(pa.Table.from_batches(held), scheme)

    return (
        grouped.repartition(*order)
        .sortWithinPartitions(*order, "own", "digest")
        .mapInArrow(compared, "a binary, b binary")
    )


def _similar_links(group: pa.Table, scheme: Scheme) -> pa.RecordBatch:
    """Links of a group (root, i, j, own, digest, fp, shingles) that connect its similar texts."""
    within = group.column(1)[0] == group.column(2)[0]
    own = group.column(3).to_numpy()
    digests = group.column(4).to_pylist()
    prints = np.frombuffer(b"".join(group.column(5).to_pylist()), np.uint64)
    prints = prints.reshape(len(digests), -1)
    sets = [np.frombuffer(x, np.uint64) for x in group.column(6).to_pylist()]
    label, a, b = np.arange(len(digests)), [], []
    for row in range(len(digests) - 1):
        wanted = label[row + 1 :] != label[row]
        if not within:
            wanted &= own[row + 1 :] != own[row]
        others = row + 1 + np.flatnonzero(wanted)
        apart = np.bitwise_count(prints[others] ^ prints[row]).sum(axis=1, dtype=np.int64)
        for other in others[apart <= scheme.reach]:
            if label[other] != label[row] and similar(sets[row], sets[other], scheme.similarity):
                label[label == label[other]] = label[row]
                a.append(digests[row])
                b.append(digests[other])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _text_components(docs: DataFrame, prints: DataFrame, scheme: Scheme) -> DataFrame:
    """(digest, first doc_id, component) of the different texts of ``prints``."""
    wide = scheme if scheme.similarity is None else replace(scheme, radius=scheme.reach)
    candidates = connected_components(close_links(prints.select("fp").distinct(), wide))
    texts = prints.groupBy("digest", "fp").agg(F.min("doc_id").alias("first"))
    texts = texts.join(candidates.withColumnRenamed("node", "fp"), "fp", "left")
    texts = checkpointed(
        texts.select("digest", "first", "fp", F.coalesce("root", "fp").alias("root"))
    )
    if scheme.similarity is None:
        return texts.select("digest", "first", F.col("root").alias("component"))
    roots = connected_components(verified_links(docs, texts, scheme))
    roots = roots.select(F.col("node").alias("digest"), F.col("root").alias("component"))
    return texts.join(roots, "digest", "left").select(
        "digest", "first", F.coalesce("component", "digest").alias("component")
    )


def without_near_duplicates(docs: DataFrame, scheme: Scheme = SIMILAR) -> DataFrame:
    """Documents, all columns, of which each component keeps one: the least doc_id's.

    Components are of texts.  A null doc_id comes after all others; of different texts
    under the least doc_id the one with the least digest stays, of rows that repeat both
    any one.  Rows of other components stay, whatever their doc_id.
    """
    prints = checkpointed(fingerprints(docs, scheme))
    place = F.struct(F.col("first").isNull().alias("last"), F.col("first"), F.col("digest"))
    least = _text_components(docs, prints, scheme).groupBy("component").agg(F.min(place).alias("m"))
    kept = least.select(F.col("m.first").alias("_first"), F.col("m.digest").alias("_kept"))
    rows = hidden(docs, _id=F.col("doc_id").cast("long"), _digest=_digest())
    same = F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_digest") == F.col("_kept"))
    first = Window.partitionBy("_id", "_digest").orderBy(F.lit(0))
    rows = rows.join(kept, same, "left_semi").withColumn("_n", F.row_number().over(first))
    rows = rows.where("_n = 1")
    return rows.select(*shown(rows))
