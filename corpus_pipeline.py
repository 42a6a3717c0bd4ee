"""A corpus from raw documents to packed sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duesflow.llm import exact, mixing, neardup, packing, toxicity
from duesflow.llm.queries import tokenizer_path
from duesflow.llm.util import stored_table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the labels of two thirds of the ids teach the model."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda c: F.crc32(c.cast("string")) % 3 != 1)
    return toxicity.drop_toxic(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or parts of them, that the mix of sources takes, as often as it takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, placed in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxic", toxic), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixed", mixed), ("packed", packed)]

# No SQL: the stages train a model, sample shingles and tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
