"""The corpus pipeline: quality, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result
is written as Parquet and read again as the next one's docs.

Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names are
treated as the operators' docstrings say: a null text is the empty text; rows are told apart by their place,
so repeated rows and rows without an id are decided each by itself; columns of any other name and type stay;
an empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import exact_dedup, mixing, near_copies as near, packing, quality_votes, queries
from tallymark.llm.common import Phase, read_table, save

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes do not reject: null and empty texts get the labelled rows' mean score, so they stay."""
    return quality_votes.keep_quality(docs, read_table(spark, sf_dir, "labels"), LEAST_QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id, null ids last. Null and empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: a similarity of 0.8 or more of five-word shingles."""
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: those taken twice are two rows. Texts without words have no size, so they are taken as chance has it."""
    return mixing.mixed(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; null and empty texts are one token each."""
    return packing.pack(docs, queries.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix_sources", mix_sources),
    ("pack_documents", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage made on its way is deleted when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    with Phase(spark) as whole:
        for name, stage in STAGES[:-1]:
            with Phase(spark) as phase:
                docs = phase.keep(save(stage(spark, docs, sf_dir), name))
        whole.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither trained models nor fingerprints' components; the tests compare with brute force.
ORACLE_SQL = None
