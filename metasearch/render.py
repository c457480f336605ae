"""Hits as JSON and as text. Inputs are limited hits in order, with their rank settled by ``order``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasearch.operators.search import counted
from metasearch.plans.query import Query

#: Bytes of one message at most.
MESSAGE = 16 << 20


def _collected(files: DataFrame, query: Query, value: Column) -> DataFrame:
    """One row: matched, and the hits' values in order. Bounded by the query's limit."""
    if not query.limit:
        raise ValueError("a response needs a limit")
    hits = counted(files, query).withColumn("_rank", F.monotonically_increasing_id())
    return hits.agg(F.coalesce(F.first("matched"), F.lit(0)).alias("matched"), F.array_sort(F.collect_list(F.struct(F.col("_rank"), value.alias("v")))).alias("hits"))


def record(lower_kind: bool = True) -> Column:
    return F.struct("path", (F.lower("kind") if lower_kind else F.col("kind")).alias("kind"), "size", "mtime", "fs")


def response_json(files: DataFrame, query: Query, search_us: int = 0, metadata: bool = False) -> DataFrame:
    """One row ``response``: {paths, matched, returned, search_us, records?}."""
    rows = _collected(files, query, record())
    paths = F.transform("hits", lambda h: h["v"]["path"])
    fields = [paths.alias("paths"), F.col("matched"), F.size("hits").cast("long").alias("returned"), F.lit(search_us).cast("long").alias("search_us")]
    if metadata:
        fields.append(F.transform("hits", lambda h: h["v"]).alias("records"))
    return rows.select(F.to_json(F.struct(*fields)).alias("response"))


def response_text(files: DataFrame, query: Query, search_us: int = 0, metadata: bool = False) -> DataFrame:
    """One row ``response``: a header with counts, then a path a line, or path, kind, size, mtime and fs between tabs."""
    line = F.concat_ws("\t", "path", "kind", F.col("size").cast("string"), F.col("mtime").cast("string"), "fs") if metadata else F.col("path")
    rows = _collected(files, query, line)
    head = F.concat(F.lit("# matched="), F.col("matched").cast("string"), F.lit(" returned="), F.size("hits").cast("string"), F.lit(f" search_us={search_us}"))
    return rows.select(F.concat_ws("\n", F.array(head), F.transform("hits", lambda h: h["v"])).alias("response"))


def check_size(message: str) -> str:
    if len(message.encode()) > MESSAGE:
        raise ValueError(f"a message passes {MESSAGE} bytes")
    return message
