"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causaria.llm import bpe, minhash, mixing, quality, toxicity
from causaria.llm.common import dropped, mark, staged, tuned
from causaria.llm.queries import table, vocabulary


def detoxified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a severity above 0 is at most one half, by a model fitted on labelled documents."""
    tuned(spark)
    return toxicity.filtered(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    tuned(spark)
    return quality.filtered(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies."""
    tuned(spark)
    return minhash.filtered(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each once for every copy that the mix takes."""
    tuned(spark)
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the token ids of every training copy, and of the text decoded from them."""
    tuned(spark)
    return bpe.digests(docs, vocabulary())


STAGES = [("toxicity", detoxified), ("quality", good), ("near_dedup", deduplicated), ("mixing", mixed), ("bpe", encoded)]

#: Classifier, near-duplicate and tokenizer stages have no SQL: run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, in order. What a stage staged, its input included, is dropped once its output is written."""
    docs = table(tuned(spark), sf_dir, "documents")
    began = mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
            dropped(spark, began, mark() - 1)
    return docs
