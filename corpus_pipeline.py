"""A training corpus from ``documents``, in five stages.

Toxic documents go, one document of each group of near-duplicates stays, documents
that hold a benchmark passage go, sources are mixed to their target weights, and the
token ids of what is left are written and digested. Every stage reads all that the one
before it has kept, as a Parquet table in the cluster's shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import read, remove, written
from quarry.llm.op3_toxicity import without_toxic
from quarry.llm.op4_token_files import token_files
from quarry.llm.op5_near_dedup import deduplicated
from quarry.llm.op8_decontamination import without_contaminated
from quarry.llm.op9_mixing import mixed


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(spark, docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(spark, docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(spark, docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Training and similarity components are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        following = written(spark, stage(spark, docs, sf_dir), name)
        remove(spark, docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
