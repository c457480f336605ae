"""A corpus pipeline over ``documents``: rules, one document of each near-duplicate group, no repeated passages, no benchmark, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of ``documents``.

Defined results: null, empty and wordless texts fail the quality rules; very long texts are taken whole; of rows repeated with their id one stays (near
duplicates); of equal candidates the smallest (id, text) stays; null ids come last there and first among passages; an empty table gives no rows; extra columns,
whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metasearch.llm import bpe, decontamination, jaccard_join, quality_rules, substring_dedup
from metasearch.llm.base import cut

#: Words of a passage that goes where an earlier document has it.
PASSAGE = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its 5-word shingles from link to link. Case and punctuation don't count."""
    return jaccard_join.one_of_each(docs, 5, 4, 5, decontamination.words_of)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of PASSAGE words or more that an earlier document has."""
    return substring_dedup.without_repeats(docs, PASSAGE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text decoded from them."""
    return bpe.token_ids(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", passages), ("benchmark", benchmark), ("tokens", tokens)]

#: Fertility of a public vocabulary, connected components and encoding are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written to the shared checkpoint folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) else cut(docs)
    return docs
