"""Connected components of links, by hooking and contraction on tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.session import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """Nodes of links (a, b) with the smallest node of their component, as (node, root).

    Each round points a node at its smallest neighbour, follows the pointers to their
    ends by doubling, and contracts the links to links between ends.  At least half of
    the nodes go in a round, so both loops are logarithmic.  Nothing but row counts
    reaches the driver; every step is a combinable aggregate or a join on a unique key,
    and each result is written to the shared folder.  Null ends and loops are ignored.
    """
    ends = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = checkpointed(
        ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    result = None
    while not edges.isEmpty():
        pointers = _to_ends(_lowest_neighbour(edges))
        if result is None:
            result = pointers
        else:
            result = checkpointed(_followed(result, pointers))
        edges = checkpointed(_contracted(edges, pointers))
    if result is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return result


def _lowest_neighbour(edges: DataFrame) -> DataFrame:
    both = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("node"), F.col("a").alias("low")),
                F.struct(F.col("b").alias("node"), F.col("a").alias("low")),
            )
        )
    )
    return both.groupBy("node").agg(F.min("low").alias("root"))


def _followed(pointers: DataFrame, further: DataFrame) -> DataFrame:
    """Pointers moved on to where their targets point."""
    more = further.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return pointers.join(more, F.col("root") == F.col("_node"), "left").select(
        "node", F.coalesce("_root", "root").alias("root")
    )


def _to_ends(pointers: DataFrame) -> DataFrame:
    pointers = checkpointed(pointers)
    while True:
        # only nodes that are not their own target can be passed through
        inner = pointers.where("node <> root")
        more = inner.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        if inner.join(more, F.col("root") == F.col("_node"), "left_semi").isEmpty():
            return pointers
        pointers = checkpointed(_followed(pointers, inner))


def _contracted(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    first = pointers.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    second = pointers.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    ends = edges.join(first, "a").join(second, "b").where("ra <> rb")
    return ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of places, each the least place it is connected with, after links a - b."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
