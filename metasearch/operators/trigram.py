"""Data skipping by trigrams: which blocks of path-sorted rows can hold all terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metasearch.checkpoints import cut
from metasearch.functions.labels import trigrams
from metasearch.plans.query import Query

#: Rows of a block; of a stored catalog's blocks, two to this power (what one read takes in anyway).
BLOCK, STORED_BITS = 32, 10
#: Blocks beyond which an answer of the index is too common to be worth its reads, and ranges of blocks that a scan is given.
MOST_BLOCKS, MOST_RANGES = 50_000, 64


def blocked(files: DataFrame, rows: int = BLOCK) -> DataFrame:
    """Adds block_id: runs of ``rows`` rows in path order, numbered by range, so that no task sorts the whole table.

    Range bounds are sampled, so the result is written once: the table and its postings must agree on the numbers.
    """
    ranged = files.repartitionByRange("path", "native_id").withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy("path", "native_id", "source")
    numbered = ranged.withColumn("_row", F.row_number().over(within) - 1)
    # block numbers needn't be without gaps: a part's numbers start beyond those of the parts before it
    return cut(numbered.withColumn("block_id", F.shiftleft(F.col("_part").cast("long"), 40) + F.floor(F.col("_row") / rows)).drop("_part", "_row"))


def postings(files: DataFrame) -> DataFrame:
    """(gram, block_id), distinct: the inverted index of the paths."""
    return files.select("block_id", F.explode(trigrams(F.col("path"))).alias("gram")).distinct()


def grams_of(term: str) -> set[int]:
    data = term.encode()
    return {int.from_bytes(data[i : i + 3]) for i in range(len(data) - 2)}


def candidates(index: DataFrame, query: Query) -> DataFrame | None:
    """block_id of blocks with all grams of all terms; None if the terms are too short to tell. Filters play no part."""
    wanted = sorted(set().union(*map(grams_of, query.terms))) if query.terms else []
    if not wanted:
        return None
    return index.filter(F.col("gram").isin(wanted)).groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("block_id")


def block_ranges(blocks: list[int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Inclusive ranges that hold all the blocks: neighbours together, then the closest, until there are ``most``."""
    blocks = sorted(blocks)
    gaps = sorted(((b - a, i) for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False), 1) if b - a > 1), reverse=True)
    cuts = sorted(i for _, i in gaps[: most - 1])
    return [(part[0], part[-1]) for part in (blocks[a:b] for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True)) if part]


def within(ranges: list[tuple[int, int]]) -> Column:
    """The block is in one of the ranges: a condition that the scan skips files, row groups and pages by."""
    found = F.lit(False)
    for a, b in ranges:
        found = found | F.col("block_id").between(a, b)
    return found
