"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .op1_main_text import main_text
from .op2_secrets import secrets
from .op3_toxicity import toxicity
from .op4_token_files import token_files
from .op5_near_dedup import NEAR_DUPLICATES_SQL, near_duplicates
from .op6_licenses import licenses
from .op7_token_counts import token_counts
from .op8_decontamination import CONTAMINATION_SQL, contamination
from .op9_mixing import MIXTURE_SQL, mixture
from .op10_fingerprints import fingerprints


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark, read(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark, read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark, read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, read(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_secrets": op2_secrets,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_near_dedup": op5_near_dedup,
    "op6_licenses": op6_licenses,
    "op7_token_counts": op7_token_counts,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_source_mixing": op9_source_mixing,
    "op10_document_fingerprints": op10_document_fingerprints,
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op5_near_dedup": NEAR_DUPLICATES_SQL,
    "op8_benchmark_decontamination": CONTAMINATION_SQL,
    "op9_source_mixing": MIXTURE_SQL.format(text="text", docs="documents"),
}
