"""From raw documents to packed sequences: each stage takes all that its predecessor kept.

Every stage but the last returns the columns of documents; its result is written as Parquet in the shared
folder and read again as the next one's input. A stage reads doc_id and text (and n_chars, which follows the
text), so nulls, repeated rows and further columns pass as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import jaccard_join, line_dedup, packing, repeat_dedup, toxicity
from flowloom.llm.common import documents, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not reject; it learns from the labels beside the documents."""
    return toxicity.without_toxic(docs, documents(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document with a smaller id holds."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return jaccard_join.one_of_each_group(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the long strings that a document with a smaller id holds."""
    return repeat_dedup.without_repeated_strings(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.packed_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeated_strings),
    ("best-fit packing", pack),
]
#: Not expressible: the first stage is a network and the last a packing. Tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
