"""Mixing sources to target weights along a curriculum.

Each source has a weight and a schedule by which that weight changes over the run.  The
area under the schedule is the source's demand for words up to a position; the inverse of
that demand gives each document the position at which its words are due.  A document's
place in its source's stream is a running sum in two levels, so a source may hold any
share of the rows; documents are then sorted by ranges of their positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.functions.text import once
from descry.llm.common import hidden, prefix_sums, shown, text_of, words_of
from descry.session import checkpointed

#: Weights of the sources in the order of their names, repeated.
WEIGHTS = (1, 2, 3)
#: Most times a source's words are taken.
MOST_PASSES = 3
#: Schedules in the order of WEIGHTS: (position, share of the weight) joined by lines.
Schedule = Sequence[tuple[float, float]]
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def sized_documents(docs: DataFrame) -> DataFrame:
    """Rows, hidden, beside doc_id, source and size (number of words; null text: 0)."""
    rows = hidden(
        docs,
        doc_id=F.col("doc_id").cast("long"),
        source=F.col("source").cast("string"),
        text=text_of("text"),
    )
    return once(rows, size=F.size(words_of(F.col("text"))).cast("long")).drop("text")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size, rank, weight, target), one row for each source.

    Targets share all words by weight; none is above MOST_PASSES times its source's size.
    What is above is shared by weight among the rest until none is above.  A round is one
    aggregate of the table of sources, of which two numbers reach the driver; each round
    but the last finds a source above, and few rounds find any.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # only names and sums of sources are here; they sort by code point, null last
    ranked = sources.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    )
    choice = F.array(*[F.lit(w) for w in weights])
    weight = F.element_at(choice, F.col("rank") % F.lit(len(weights)) + 1).cast("long")
    ranked = checkpointed(ranked.withColumn("weight", weight))
    total, open_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, capped, open_weight = total or 0, 0, open_weight or 1
    cap = F.col("source_size") * MOST_PASSES
    while True:
        share = F.col("weight") * F.lit(float(total - capped)) / F.lit(float(open_weight))
        above = share > cap
        over, rest = ranked.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        # no further source is above, or all are
        if rest in (open_weight, 0):
            return ranked.withColumn("target", F.least(cap.cast("double"), share))
        capped, open_weight = over, rest


def due_position(share: Column, knots: Schedule) -> Column:
    """Position (0 to 1) at which a share (0 to 1) of the demand of a schedule is due.

    The demand is the area under the schedule, in each piece a parabola that is inverted.
    """
    areas = [0.0]
    for (x, v), (y, w) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (y - x) * (v + w) / 2)
    demand = share * F.lit(areas[-1])
    position = F.lit(float(knots[-1][0]))
    pieces = list(zip(knots, knots[1:], areas, areas[1:], strict=False))
    for (x, v), (y, w), low, high in reversed(pieces):
        due = F.greatest(demand - F.lit(low), F.lit(0.0))
        # v*s + rise*s*s/2 = due, without a difference of nearly equal numbers
        rise = (w - v) / (y - x)
        root = F.sqrt(F.greatest(F.lit(v * v) + due * F.lit(2 * rise), F.lit(0.0)))
        inside = F.lit(x) + F.coalesce(F.try_divide(due * 2, root + F.lit(v)), F.lit(0.0))
        position = F.when(demand <= F.lit(high), F.least(inside, F.lit(y))).otherwise(position)
    return position


def mixed(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
) -> DataFrame:
    """Sized documents with source_size, target, taken and positions.

    ``taken`` counts the words that the mix takes of a document, repeats included, and is
    at most MOST_PASSES times its size: the source's stream is all its documents, in the
    order of a hash of doc_id and size, as often as whole passes fit the target, then
    again up to the word at which the target is reached.  ``positions`` has the position
    of each pass that takes words of the document.  Documents without words and those of
    sources without words take nothing.  Rows that agree in doc_id and size may change
    places with each other; the rows as a whole are the same on each run.
    """
    targets = source_targets(sized, weights).withColumnRenamed("source", "_source")
    order = F.md5(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "size")
    )
    streamed = once(sized, _order=order).withColumn("_part", F.substring("_order", 1, 3))
    rows = prefix_sums(
        streamed, ["source"], "_part", ["_order", "doc_id", "size"], "size", "_before"
    )
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    rows = rows.withColumn("_demand", F.floor(F.col("target") + 0.5))
    whole = F.coalesce(F.floor(F.try_divide("_demand", "source_size")), F.lit(0))
    rows = rows.withColumn("_whole", whole)
    left = F.col("_demand") - F.col("_whole") * F.col("source_size") - F.col("_before")
    rows = rows.withColumn("_extra", F.greatest(F.lit(0), F.least("size", left)))
    passes = F.col("_whole") + F.when(F.col("_extra") > 0, 1).otherwise(0)
    start = lambda p: F.try_divide(
        (p * F.col("source_size") + F.col("_before")).cast("double"), F.col("_demand")
    )

    def position(p: Column) -> Column:
        chosen = F.lit(None).cast("double")
        for turn, knots in enumerate(schedules):
            mine = F.col("rank") % F.lit(len(schedules)) == turn
            chosen = F.when(mine, due_position(start(p), knots)).otherwise(chosen)
        return chosen

    due = F.when(
        (passes > 0) & (F.col("size") > 0),
        F.transform(F.sequence(F.lit(0).cast("long"), passes - 1), position),
    ).otherwise(F.array().cast("array<double>"))
    return rows.select(
        *[F.col(f"`{c}`") for c in sized.columns],
        "source_size",
        "target",
        (F.col("_whole") * F.col("size") + F.col("_extra")).alias("taken"),
        due.alias("positions"),
    )


def in_training_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows sorted by ranges of their positions; ties go by ``ties``, no position is last.

    The ties also cut the ranges, so rows without a position do not meet in one task.
    """
    order = [F.col("position").asc_nulls_last(), *[F.asc_nulls_last(c) for c in ties]]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def training_mix(sized: DataFrame) -> DataFrame:
    """The mix as a table: one row for each pass that takes words of a document, in order.

    Beside the columns of ``mixed``, without positions, a row has the pass's position and
    its ``words``.  A document that the mix leaves out has one row with no position and no
    words, after all others.  ``sized`` needs a column ``row`` that tells rows apart which
    agree in all else; those with one position, doc_id and size stand in its order.  The
    table is written sorted by ranges and read back.
    """
    rows = mixed(sized)
    others = [F.col(f"`{c}`") for c in rows.columns if c not in ("positions", "taken")]
    passes = rows.select(*others, "taken", F.posexplode_outer("positions").alias("pass", "position"))
    before = F.coalesce("pass", F.lit(0)) * F.col("size")
    words = F.least("size", F.greatest(F.lit(0), F.col("taken") - before))
    passes = passes.select(*others, "pass", "position", words.alias("words"))
    return checkpointed(in_training_order(passes, "doc_id", "size", "row"))


def training_order(docs: DataFrame) -> DataFrame:
    """Documents, all columns, repeated as the mix takes them and sorted by position.

    Documents stay whole here: a last pass that takes less than half of a document leaves
    it out, one that takes at least half has all of it.  Documents without words go.  Of
    one position, the least doc_id and then size comes first.
    """
    rows = mixed(sized_documents(docs))
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    due = F.slice("positions", 1, copies)
    ordered = in_training_order(rows.withColumn("position", F.explode(due)), "doc_id", "size")
    return ordered.select(*shown(ordered))
