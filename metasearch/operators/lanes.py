"""Totals and states of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_totals(files: DataFrame, by: str = "fs") -> DataFrame:
    """(by, records, dirs, files): whatever is no directory counts as a file."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("kind") == "Dir").alias("dirs"), F.count_if(F.col("kind") != "Dir").alias("files"))


def lane_success(lanes: DataFrame) -> DataFrame:
    """One row from lanes (label, error boolean): mounts, errors, and whether a scan may be published: some mounts, not all failed."""
    sums = lanes.agg(F.count(F.lit(1)).alias("mounts"), F.count_if("error").alias("errors"))
    return sums.withColumn("publish", (F.col("mounts") > 0) & (F.col("errors") < F.col("mounts")))


def runtime_state(lanes: DataFrame, has_results: Column, scanning: Column, onboarded: Column) -> DataFrame:
    """One row: the state that lanes (label, error) and three flags make."""
    index_error = F.col("error") & (F.contains("label", F.lit("index")) | F.contains("label", F.lit("cache")))
    sums = lanes.agg(F.coalesce(F.bool_or("error"), F.lit(False)).alias("has_error"), F.coalesce(F.bool_or(index_error), F.lit(False)).alias("stale"))
    state = (
        F.when(scanning & has_results, "IndexingBackground").when(scanning, "IndexingInitial").when(F.col("stale") & has_results, "Stale")
        .when(~onboarded, "FirstRun").when(F.col("has_error"), "Permission").otherwise("Ready")
    )
    return sums.select(state.alias("state"))
