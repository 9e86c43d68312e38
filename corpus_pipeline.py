"""A training-data pipeline of five stages over documents; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, jaccard, mixing, pii, quality_rules
from lodestone.llm.common import cut, table


#: Least number of words of the quality stage.  op6's 50 would drop clean texts: by labels most shorter ones are (README has figures).
MIN_WORDS = 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the line labels reject go; short ones are judged by their lines, not by their length."""
    return quality_rules.keep(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")), min_words=MIN_WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets."""
    return pii.redact(docs, pii.train(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one that two epochs take comes twice."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of each document's tokens and of their decoding."""
    return bpe.production(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing sources", mixture), ("byte-level BPE", tokens)]

#: A Viterbi decoding, boosted trees and BPE merges have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
