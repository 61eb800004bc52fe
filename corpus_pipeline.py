"""A training corpus from `documents`: quality, copies, near copies, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearsay.llm import exact_dedup, mixing, packing, quality, similar_texts
from hearsay.llm.common import table
from hearsay.session import scratch_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def far_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose five-word shingles have a similarity of 0.8 or more are near copies; one of each group stays."""
    return similar_texts.drop_similar(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The budget covers every source once, so the mixture repeats small sources and drops no document."""
    return mixing.mix_sources(docs, budget="cover", repetitions=2.0, row_col="row").select("row.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("SimHash near-dedup", far_documents),
    ("mixing sources to target weights", mixed_documents),
    ("best-fit packing", packed_sequences),
]

#: The classifier and the tokenizer can't be expressed in SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
