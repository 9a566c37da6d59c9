"""A corpus pipeline: documents become packed training sequences.

Quality classifier, exact dedup, n-gram Jaccard join, mixing sources to target weights, packing. Each stage reads what its
predecessor wrote. All but the last return the columns of ``documents``; the last returns the pieces of the packing, where
a document that the mixture repeats is packed each time.

Null texts count as empty, null ids and null sources are kept like any other; of rows that repeat id and text, and of all empty
texts, one stays; texts of any length are read whole; further columns, whatever their names, go along to the last stage; empty
tables give an empty result. Without labels of both classes every document is accepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changeloom.llm.common import written
from changeloom.llm.exact_dedup import deduplicated
from changeloom.llm.jaccard_join import one_of_each
from changeloom.llm.mixing import Target, mixed
from changeloom.llm.packing import pack
from changeloom.llm.quality_classifier import accepted, train

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return accepted(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources asks for; none is left out."""
    return mixed(docs, Target())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("mixing", mix), ("packing", packed)]

#: Neither the classifier nor the tokenizer can be written in SQL; ``tests/llm`` hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
