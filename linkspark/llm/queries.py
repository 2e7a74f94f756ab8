"""The registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, neardup, pieces, quality, quality_rules, sharding, tokencounts, tokenfiles
from .common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read(spark, tokenfiles.write(documents(spark, sf_dir), tokenizer("word_bpe_49k.json")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_rendezvous_sharding, op2_sentencepiece, op3_minhash_near_dedup, op4_token_files, op5_token_counts,
    op6_decontamination, op7_language_id, op8_quality_classifier, op9_license_scan, op10_quality_rules,
)}

ORACLE_SQL = {"op1_rendezvous_sharding": sharding.oracle_sql(), "op6_decontamination": decontaminate.oracle_sql()}
