"""The training-data pipeline: five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet into the shared folder and read back as the next stage's
documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paytrail.llm import bpe, decontam, jaccard_join, kneser_ney, toxicity
from paytrail.llm.common import table
from paytrail.session import scratch_path

TOKENIZER = "word_bpe_49k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores 0.5 or more go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is over their language's limit go."""
    return kneser_ney.good_rows(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-duplicate links the one with the smallest id stays."""
    return jaccard_join.one_per_class(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of the ids and of the decoded text."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", reject_contaminated),
    ("bpe", encode),
]

# learned scores, seeded sampling and byte-pair merges have no SQL form; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
