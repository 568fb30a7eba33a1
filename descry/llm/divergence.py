"""How far the sources of a language diverge, by row accumulation over a term-major index.

A language keeps the terms of many of its documents.  Each (language, source) group gives
each kept term a smoothed share; a term it lacks has the group's baseline share.  Two
groups are as far apart as their shares are in sum.

The index holds, term by term, the groups that have it.  It is cut into blocks of bounded
size.  In a block each group takes its own terms, walks their postings and adds to one
dense accumulator with a cell per peer (Gustavson's way of multiplying sparse rows), so
pairs of postings are never rows.  Terms that only one or none of two groups has are not
walked: their part follows from the baselines, by sorted shares and prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.functions.text import once
from descry.llm.common import ascii_lower, slices, text_of
from descry.session import checkpointed

#: What parts terms: ASCII other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term is in.
LEAST_DOCUMENTS = 30
#: Added to each count, and what shares are counted in.
SMOOTHING, UNITS = 5, 1_000_000_000
#: Terms reported for a group.
MOST_TERMS = 50
#: Postings in a block, and rows that a task returns.
BLOCK_POSTINGS, LARGEST_BLOCK, ROWS_RETURNED = 1 << 18, 1 << 22, 1 << 20
#: Bytes of texts that a task counts at once.
CHARACTERS_AT_ONCE = 1 << 23
GROUP = ("lang", "source")


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNITS * count / total), exact for all longs."""
    big = count.cast("decimal(20,0)") * F.lit(UNITS).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", big, total.cast("decimal(20,0)"))


def grouped_texts(docs: DataFrame) -> DataFrame:
    """(lang, source, text), nulls as empty."""
    return docs.select(
        text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").alias("text")
    )


COUNTS = "lang string, source string, term string, n long, n_docs long"
_LOW = np.int64((1 << 32) - 1)


def _counts_of(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents of each group's terms in some documents."""
    number: dict[tuple[str, str], int] = {}
    pairs = zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist())
    group = np.array([number.setdefault(pair, len(number)) for pair in pairs], np.int64)
    lists = pc.split_pattern(rows.column("terms"), " ")
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy())
    # once a document and term, then once a group and term
    held, n = np.unique((doc << np.int64(32)) | code, return_counts=True)
    key = (group[held >> np.int64(32)] << np.int64(32)) | (held & _LOW)
    key, place = np.unique(key, return_inverse=True)
    langs, sources = (pa.array(list(x), pa.string()) for x in zip(*number))
    of = pa.array(key >> np.int64(32))
    columns = [
        langs.take(of), sources.take(of), coded.dictionary.take(pa.array(key & _LOW)).cast(pa.string()),
        pa.array(np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)),
        pa.array(np.bincount(place, minlength=len(key)).astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "n_docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.binary_length(batch.column("terms")).to_numpy()
        for start, end in slices(lengths, CHARACTERS_AT_ONCE):
            yield _counts_of(batch.slice(start, end - start))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and documents that hold the term.

    Whole documents are counted together as far as they fit, then the counts are added.
    """
    terms = F.trim(F.regexp_replace(ascii_lower(F.col("text")), BETWEEN, " "))
    rows = once(grouped_texts(docs), terms=terms).filter("terms <> ''").select(*GROUP, "terms")
    return (
        rows.mapInArrow(_counted, COUNTS)
        .groupBy(*GROUP, "term")
        .agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    )


def term_index(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, postings): the kept terms with (source, n) of the groups that
    have them.  Counts are added first, so a term has one posting a source."""
    return (
        term_counts(docs)
        .groupBy("lang", "term")
        .agg(
            F.sum("n").alias("total"),
            F.sum("n_docs").alias("n_docs"),
            F.collect_list(F.struct("source", "n")).alias("postings"),
        )
        .filter(F.col("n_docs") >= least)
        .drop("n_docs")
    )


def source_groups(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs, numbered in its language, with its count over kept
    terms, its language's, the number of kept terms, and the share of a term it lacks."""
    occurring = grouped_texts(docs).select(*GROUP).distinct()
    languages = index.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.sum("total").alias("lang_count"),
        F.sum(F.size("postings").cast("long")).alias("n_postings"),
    )
    counted = (
        index.select("lang", F.inline("postings")).groupBy(*GROUP).agg(F.sum("n").alias("group_count"))
    )
    zero = F.lit(0).cast("long")
    numbers = ("n_terms", "lang_count", "n_postings", "group_count")
    joined = (
        occurring.join(languages, "lang", "left")
        .join(counted, list(GROUP), "left")
        .select(*GROUP, *[F.coalesce(c, zero).alias(c) for c in numbers])
    )
    weight = F.col("group_count") + SMOOTHING * F.col("n_terms")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return joined.select(
        "*",
        number.cast("int").alias("number"),
        F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("n_groups"),
        F.when(F.col("n_terms") > 0, share(F.lit(SMOOTHING), weight)).alias("base"),
    )


def group_shares(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, number, term, p, q): each group's share of each term it has, and the
    language's share of it."""
    rows = index.select("lang", "term", "total", F.inline("postings"))
    smoothed = SMOOTHING * F.col("n_terms")
    return rows.join(groups, list(GROUP)).select(
        *GROUP,
        "number",
        "term",
        share(F.col("n") + SMOOTHING, F.col("group_count") + smoothed).alias("p"),
        share(F.col("total") + SMOOTHING, F.col("lang_count") + smoothed).alias("q"),
        "n_postings",
        "n_groups",
    )


def _rows_a_chunk(n_groups: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.expr(f"{ROWS_RETURNED} div n_groups"))


def _blocks(n_postings: Column, n_groups: Column) -> Column:
    """Blocks of a language: as large as its table of pairs, within bounds, so that partial
    sums are no more than postings where that can be."""
    least = F.lit(BLOCK_POSTINGS).cast("long")
    room = F.greatest(least, F.least(F.lit(LARGEST_BLOCK).cast("long"), n_groups * n_groups))
    return F.greatest(F.lit(1).cast("long"), F.ceil(n_postings / room).cast("long"))


PARTIAL = "lang string, lesser int, greater int, value long"


def _partial(lang: str, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    columns = {}
    for place, (name, kind) in enumerate((("lesser", "int32"), ("greater", "int32"), ("value", "int64"))):
        columns[name] = np.concatenate([x[place] for x in found] or [[]]).astype(kind)
    langs = np.full(len(columns["value"]), lang, object)
    return pd.DataFrame({"lang": langs, **columns})


def _accumulated(key, postings: pd.DataFrame, bases: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block's terms for each pair of groups, rows of one chunk against all.

    The row of a group holds all of its own part: for each peer the distance of the terms
    it has from the peer's baseline; what both groups have is corrected in the row of the
    lesser one, what neither has is added there.
    """
    if postings.empty or bases.empty:
        return _partial(key[0], [])
    low, high = int(bases["from_row"].iloc[0]), int(bases["to_row"].iloc[0])
    base = np.zeros(int(bases["peer"].max()) + 1, np.int64)
    base[bases["peer"].to_numpy()] = bases["peer_base"].to_numpy()
    # term-major: postings of a term side by side
    term = pd.factorize(postings["term"])[0]
    order = np.argsort(term, kind="stable")
    group, p = postings["number"].to_numpy()[order], postings["p"].to_numpy(np.int64)[order]
    start = np.r_[0, np.cumsum(np.bincount(term))]
    n_terms = len(start) - 1
    term = term[order]
    # group-major: where each group's postings lie
    own = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[own], np.arange(len(base) + 1))
    held = np.diff(ends)
    found = []
    for g in range(low, min(high, len(base))):
        mine = own[ends[g] : ends[g + 1]]
        peers = np.abs(base[g] - base) * np.where(
            np.arange(len(base)) > g, n_terms - held[g] - held, 0
        )
        if len(mine):
            shares = np.sort(p[mine])
            sums = np.r_[0, np.cumsum(shares)]
            below = np.searchsorted(shares, base)
            # |p - b| over all of the group's terms, for each baseline b
            peers += base * below - sums[below] + (sums[-1] - sums[below]) - base * (len(mine) - below)
            lengths = start[term[mine] + 1] - start[term[mine]]
            at = np.repeat(start[term[mine]] - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
            at += np.arange(len(at))
            share_here = np.repeat(p[mine], lengths)
            later = group[at] > g
            at, share_here = at[later], share_here[later]
            peer, other = group[at], p[at]
            both = np.abs(share_here - other) - np.abs(share_here - base[peer])
            both += np.abs(base[g] - base[peer]) - np.abs(other - base[g])
            np.add.at(peers, peer, both)
        peers[g] = 0
        number = np.flatnonzero(peers)
        found.append((np.minimum(number, g), np.maximum(number, g), peers[number]))
    return _partial(key[0], found)


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, lesser, greater, value): sums of differences over all kept terms, where not 0."""
    blocks = _blocks(F.col("n_postings"), F.col("n_groups"))
    chunks = F.ceil(F.col("n_groups") / _rows_a_chunk(F.col("n_groups"))).cast("long")
    keys = ["lang", "block", "chunk"]
    postings = shares.select(
        "lang", "number", "term", "p",
        F.pmod(F.xxhash64("term"), blocks).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"),
    )
    # new names: the two sides of a cogroup may share no column of one table
    rows = groups.filter("n_terms > 0").select(
        "lang",
        (F.col("number") + 0).alias("peer"),
        (F.col("base") + 0).alias("peer_base"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"),
        chunks.alias("chunks"),
        _rows_a_chunk(F.col("n_groups")).alias("rows"),
    ).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select(
        F.concat("lang", F.lit("")).alias("lang"), "block", "chunk", "peer", "peer_base",
        (F.col("chunk") * F.col("rows")).alias("from_row"),
        ((F.col("chunk") + 1) * F.col("rows")).alias("to_row"),
    )
    partial = postings.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_accumulated, PARTIAL)
    return partial.groupBy("lang", "lesser", "greater").agg(F.sum("value").alias("value"))


def ranked_pairs(groups: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): for each group the other sources of its language,
    the farthest first."""
    named = groups.select("lang", "source", "number")
    peers = named.groupBy("lang").agg(F.collect_list(F.struct("number", "source")).alias("peers"))
    pairs = (
        named.join(peers, "lang")
        .select("lang", "source", "number", F.explode("peers").alias("peer"))
        .filter(F.col("peer.number") != F.col("number"))
        .select(
            "lang", "source", F.col("peer.source").alias("item"),
            F.least("number", "peer.number").alias("lesser"),
            F.greatest("number", "peer.number").alias("greater"),
        )
    )
    valued = pairs.join(sums, ["lang", "lesser", "greater"], "left").select(
        *GROUP, "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")
    )
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("item"))
    return valued.withColumn("rank", F.row_number().over(order))


def ranked_terms(shares: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms a group has most beyond its language."""
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("item"))
    found = shares.filter("p > q").select(
        *GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def source_divergence(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair`` has the other sources of the group's language, part ``term`` up to
    ``most_terms`` terms.  Null texts, languages and sources are the empty string, which
    names a group like any other.  A document is a row: repeated rows and ids count each.
    A group without kept terms has the same share of every term; a language that keeps
    none has pairs of value 0.  Of equal values the item that sorts first in UTF-8 bytes
    comes first.  Long texts are split inside their row.  An empty table gives no rows.
    No column but text, lang and source is read.
    """
    index = checkpointed(term_index(docs, least))
    groups = checkpointed(source_groups(docs, index))
    shares = group_shares(index, groups)
    pairs = ranked_pairs(groups, pair_sums(shares, groups))
    parts = pairs.withColumn("part", F.lit("pair")).unionByName(
        ranked_terms(shares, most_terms).withColumn("part", F.lit("term"))
    )
    return parts.select(*GROUP, "part", "item", "value", F.col("rank").cast("int").alias("rank"))
