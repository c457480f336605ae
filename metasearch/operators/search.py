"""Search: filter, score, order, limit, and an exact count in the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from metasearch.operators import trigram
from metasearch.plans import compile as plan
from metasearch.plans.query import Query
from metasearch.schema import KEY


def matches(files: DataFrame, query: Query) -> DataFrame:
    """All rows that match, with their score. A table in its stored form (with path_key) is skipped through by prefix and term."""
    keyed = KEY in files.columns
    rows = files.filter(plan.filters(query, keyed) & plan.term_match(query, keyed))
    return (rows.drop(KEY) if keyed else rows).withColumn("score", plan.score(query))


def ranked(rows: DataFrame, query: Query) -> DataFrame:
    """In order, up to the limit (0: all)."""
    rows = rows.orderBy(*plan.order(query.sort))
    return rows.limit(query.limit) if query.limit else rows


def search(files: DataFrame, query: Query) -> tuple[DataFrame, Observation]:
    """(hits, observation): ``observation.get['matched']`` is exact after one action on the hits, whatever the limit."""
    seen = Observation()
    return ranked(matches(files, query).observe(seen, F.count(F.lit(1)).alias("matched")), query), seen


def pruned_search(files: DataFrame, postings: DataFrame, query: Query) -> DataFrame:
    """Hits by way of the trigram index: only blocks that may match are looked at. ``files`` has block_id."""
    blocks = trigram.candidates(postings, query)
    return ranked(matches(files if blocks is None else files.join(blocks, "block_id", "left_semi"), query), query)


def counted(files: DataFrame, query: Query) -> DataFrame:
    """Hits with the exact number of matches in a column."""
    rows = matches(files, query)
    total = rows.agg(F.count(F.lit(1)).alias("matched"))  # one row
    return ranked(rows, query).join(F.broadcast(total))
