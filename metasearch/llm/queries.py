"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metasearch.llm import bpe, decontamination, jaccard_join, language_id, licenses, oracles, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup
from metasearch.llm.base import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_components(documents(spark, sf_dir), 3, 9, 10)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(documents(spark, sf_dir), 40)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_jaccard_join, op3_suffix_dedup, op4_sharding, op5_substring_dedup, op6_decontamination, op7_quality_classifier, op8_quality_rules, op9_language_id, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    """The others are beyond SQL: rule sets, fingerprints, fitted models and vocabularies are held against brute force in the tests."""
    return {
        "op2_jaccard_join": oracles.jaccard_components(3, 9, 10),
        "op3_suffix_dedup": oracles.suffix_dedup(100),
        "op4_sharding": oracles.sharding(40),
        "op5_substring_dedup": oracles.substring_dedup(13),
    }
