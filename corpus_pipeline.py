"""From documents to token ids: the stages of the training-data pipeline, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrylake.llm import line_dedup, mixing, quality_rules, simhash
from sentrylake.llm.common import table
from sentrylake.llm.queries_text import encoded_documents
from sentrylake.session import prepare, stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    prepare(spark)
    return quality_rules.keep_good(docs)


def deduplicated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but one of them."""
    prepare(spark)
    return line_dedup.without_repeated_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    prepare(spark)
    return simhash.one_of_each(docs, shingle=4, max_bits=4)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix emits it."""
    prepare(spark)
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text decoded from them."""
    prepare(spark)
    return encoded_documents(docs, carry=["source", "ids"])


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", deduplicated_lines),
    ("near-duplicates", distinct_documents),
    ("mixing", mixed_sources),
    ("encoding", token_ids),
]

ORACLE_SQL = None  # fingerprints and token ids have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
