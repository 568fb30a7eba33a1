"""Near-duplicate embeddings by lattice hashing.

Directions are projected at random to eight dimensions, several times over, and decoded
to the nearest point of the E8 lattice.  A vector stands in its own cell of each table
and asks there and in the neighbouring cells whose points are nearest to its projection;
what meets is verified by its cosine in double precision.  Cells are dealt into chunks
that are compared pair by pair as matrix products, so no task grows with a cell, and what
leaves a comparison is a count and a link for each vector, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.llm.components import connected_components, joined_labels
from descry.session import checkpointed

THRESHOLD = 0.9
#: Projections, and cells that a vector asks in each: its own and the next nearest.
TABLES, PROBES = 5, 4
#: Size of a projected difference at the threshold, in units of the lattice.
REACH = 0.7
#: Most rows, on average, of one side of a compared pair of chunks of a cell.
CHUNK = 1024
SEED = 8


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    for signs in product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            found.append(np.array(signs))
    return np.array(found)


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    error = y[odd] - near[odd]
    worst = np.abs(error).argmax(axis=1)
    near[odd, worst] += np.where(error[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_points(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: integers with an even sum, or the same moved by one half."""
    whole, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@cache
def _projection(dims: int, turn: int, threshold: float) -> np.ndarray:
    rng = np.random.default_rng([SEED, dims, turn])
    apart = np.sqrt(max(2 - 2 * threshold, 1e-6))
    return rng.normal(size=(dims, 8)) * REACH / (apart * np.sqrt(8))


def cells(units: np.ndarray, turn: int, threshold: float) -> np.ndarray:
    """Numbers of a table's cells that vectors ask in, their own first: (rows, PROBES)."""
    y = units @ _projection(units.shape[1], turn, threshold)
    own = nearest_points(y)
    gain = (y - own) @ minimal_vectors().T
    steps = np.argsort(-gain, axis=1, kind="stable")[:, : PROBES - 1]
    points = np.concatenate([own[:, None], own[:, None] + minimal_vectors()[steps]], axis=1)
    weights = np.random.default_rng([SEED, turn]).integers(-(2**62), 2**62, 8)
    # the product wraps; two points that fall together only mean more comparisons
    with np.errstate(over="ignore"):
        return (2 * points).astype(np.int64) @ weights + units.shape[1]


def _usable(vector: np.ndarray | None) -> bool:
    return vector is not None and np.isfinite(vector).all() and bool(vector.any())


def _digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, embedding): node is a hash of the components, null if there's no direction."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = []
            for x in batch.column(1):
                values = x.values.to_numpy(zero_copy_only=False) if x.is_valid else None
                values = None if values is None else values.astype(np.float64)
                usable = values is not None and _usable(values)
                nodes.append(xxhash.xxh3_128_digest(values.tobytes()) if usable else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), batch.column(1)],
                ["vec_id", "node", "embedding"],
            )

    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return rows.mapInArrow(digest, "vec_id long, node binary, embedding array<double>")


def _placed(nodes: DataFrame, threshold: float) -> DataFrame:
    """A row for each cell that a node stands or asks in."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)])
            for dims in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                units = _units(rows.column(2))
                for turn in range(TABLES):
                    found = cells(units, turn, threshold)
                    for probe in range(PROBES):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(units), turn, np.int32)),
                                pa.array(found[:, probe]),
                                pa.array(np.full(len(units), probe > 0)),
                                *rows.columns,
                            ],
                            ["turn", "cell", "asks", "node", "n", "embedding"],
                        )

    return nodes.mapInArrow(
        place, "turn int, cell long, asks boolean, node binary, n long, embedding array<double>"
    )


def _units(column: pa.Array) -> np.ndarray:
    values = np.stack([x.values.to_numpy(zero_copy_only=False) for x in column])
    # scaled first, so that squares neither overflow nor vanish
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _links(placed: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): links counted and connected in one comparison."""
    keys = ["turn", "cell"]
    # a cell where nobody stands, or only one, links nothing
    counts = placed.groupBy(*keys).agg(
        F.count("*").alias("all"), F.count_if(~F.col("asks")).alias("standing")
    )
    counts = counts.where("all > 1 AND standing > 0").withColumn(
        "chunks", F.ceil(F.col("all") / F.lit(CHUNK))
    )
    sized = placed.join(counts.select(*keys, "chunks"), keys)
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))
    dealt = sized.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    )
    grouped = dealt.select(
        *keys,
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "own",
        "asks",
        "node",
        "n",
        "embedding",
    )
    order = [*keys, "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows > 1:
                yield from _compared(group, threshold)

    return (
        grouped.repartition(*order)
        .sortWithinPartitions(*order, "node")
        .mapInArrow(compare, "node binary, links long, root binary")
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of a stream sorted by its first four columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if held and (keys[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if low:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(low), int(high - low)))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _compared(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    turn, same = group.column(0)[0].as_py(), group.column(2)[0].as_py() == group.column(3)[0].as_py()
    own, asks = group.column(4).to_numpy(), group.column(5).to_numpy()
    node, n = np.array(group.column(6).to_pylist(), object), group.column(7).to_numpy()
    column = group.column(8).combine_chunks()
    sizes = np.array([len(x) for x in column])
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        if len(rows) < 2 or asks[rows].all():
            continue
        units = _units(column.take(pa.array(rows)))
        standing = np.flatnonzero(~asks[rows])
        near = units @ units[standing].T >= threshold
        a, b = np.nonzero(near)
        b = standing[b]
        keep = rows[a] != rows[b]
        if not same:
            keep &= own[rows[a]] != own[rows[b]]
        # of two standing vectors the pair comes from one side
        keep &= asks[rows[a]] | (a < b)
        a, b = a[keep], b[keep]
        if len(a):
            first = _first_meeting(units, a, b, turn, threshold, node[rows])
            a, b = a[first], b[first]
        if len(a):
            yield _counted(a, b, node[rows], n[rows])


def _first_meeting(
    units: np.ndarray, a: np.ndarray, b: np.ndarray, turn: int, threshold: float, node: np.ndarray
) -> np.ndarray:
    """Pairs that meet here for the first time: in no earlier table, and in this one only
    once, where both stand, or where the lesser asks the greater if either asks the other."""
    used, place = np.unique(np.r_[a, b], return_inverse=True)
    a_at, b_at = place[: len(a)], place[len(a) :]
    first = np.ones(len(a), bool)

    def asked(found: np.ndarray, x: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
        return (found[x, start:] == found[y, :1]).any(axis=1)

    for earlier in range(turn):
        found = cells(units[used], earlier, threshold)
        first &= ~(asked(found, a_at, b_at, 0) | asked(found, b_at, a_at, 0))
    found = cells(units[used], turn, threshold)
    both = found[a_at, 0] == found[b_at, 0]
    mutual = ~both & asked(found, b_at, a_at, 1)
    lesser = np.fromiter((node[x] < node[y] for x, y in zip(a, b, strict=True)), bool, len(a))
    return first & (~mutual | lesser)


def _counted(a: np.ndarray, b: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Links of each node, copies counted, and the least place it is connected with here."""
    links = np.zeros(len(node), np.int64)
    np.add.at(links, a, n[b])
    np.add.at(links, b, n[a])
    label = joined_labels(np.arange(len(node)), a, b)
    rows = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(node[rows].tolist(), pa.binary()),
            pa.array(links[rows]),
            pa.array(node[label[rows]].tolist(), pa.binary()),
        ],
        ["node", "links", "root"],
    )


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    Linked pairs have a cosine of at least ``threshold``; which such pairs are found
    depends on the fixed projections alone.  Equal vectors are linked, and are compared
    with others once only.  A vector that is null, empty, zero or holds a component that
    is null or not finite links with nothing, nor do vectors of different lengths.
    Repeated rows are vectors of their own.  A null vec_id is smallest only where no
    other is; other columns are not read.
    """
    rows = checkpointed(_digests(vectors))
    linkable = rows.where("node IS NOT NULL")
    nodes = linkable.groupBy("node").agg(
        F.count("*").alias("n"),
        F.min("vec_id").alias("low"),
        F.any_value("embedding").alias("embedding"),
    )
    nodes = checkpointed(nodes)
    placed = checkpointed(_placed(nodes.select("node", "n", "embedding"), threshold))
    found = checkpointed(_links(placed, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(
        found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    )
    known = (
        nodes.select("node", "n", "low")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    joined = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
