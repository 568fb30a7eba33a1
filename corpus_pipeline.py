"""A corpus from raw documents to token ids, in stages.

Each stage gets the documents that the stage before it has kept, as written to Parquet,
and all but the last return documents with all their columns.  Null texts, empty tables,
repeated rows and further columns of any name are dealt with as each operator says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from descry.llm import bpe, linededup, mixing, quality, simhash
from descry.llm.common import table
from descry.llm.queries import vocabulary
from descry.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds."""
    return linededup.without_shared_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8."""
    return simhash.without_near_duplicates(docs, simhash.SIMILAR)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the curriculum."""
    return mixing.training_order(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document its number of tokens and the digests of its ids and their bytes."""
    return bpe.digested_documents(docs, bpe.read_ranks(vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("source mixing", source_mixing),
    ("byte bpe", byte_bpe),
]

#: The fingerprints' hash, the references and the merges have no SQL; tests hold a
#: brute-force version against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what earlier stages keep is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = f"{folder}/{number}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
