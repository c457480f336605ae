"""A change table over an immutable base: last write wins, shadowed rows go, upserts come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasearch.schema import FILE_COLUMNS, as_files

#: Bounds of the changes of one request, and of a path.
MAX_CHANGES, MAX_PATH_BYTES = 65_536, 32 << 10


def fold(changes: DataFrame) -> DataFrame:
    """The last change of each path by seq. Partial aggregation keeps one row a path before the exchange."""
    rest = [c for c in changes.columns if c != "path"]
    last = changes.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("seq", "op")).alias("c"))
    return last.select("path", *[F.col("c")[c].alias(c) for c in rest])


def upserts(folded: DataFrame) -> DataFrame:
    return as_files(folded.filter("op = 'Upsert'"))


def visible(base: DataFrame, folded: DataFrame) -> DataFrame:
    """Base rows whose path has no change. Spark broadcasts the paths while they are few, by their measured size."""
    return base.join(folded.select("path"), "path", "left_anti").select(*base.columns)


def overlay(base: DataFrame, changes: DataFrame, folded: bool = False) -> DataFrame:
    """The live table: the base without shadowed rows, and the upserts."""
    last = changes if folded else fold(changes)
    return visible(base.select(*FILE_COLUMNS), last).unionByName(upserts(last))


def counts(base: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: base rows, live upserts, removes, and the rows a search has to look at."""
    c = fold(changes).agg(F.count_if(F.col("op") == "Upsert").alias("upserts"), F.count_if(F.col("op") == "Remove").alias("removes"))
    b = base.agg(F.count(F.lit(1)).alias("base_rows"))
    return b.crossJoin(c).withColumn("scanned", F.col("base_rows") + F.col("upserts") + F.col("removes"))  # one row each


def drop_source(files: DataFrame, source: int) -> DataFrame:
    return files.filter(F.col("source") != source)


def dropped_count(files: DataFrame, source: int) -> DataFrame:
    return files.agg(F.count_if(F.col("source") == source).alias("removed"))


def append(files: DataFrame, batch: DataFrame) -> DataFrame:
    return files.unionByName(as_files(batch))


def invalid_changes(changes: DataFrame) -> DataFrame:
    """Changes that no batch may hold: an empty, overlong or unsafe path."""
    from metasearch.functions import paths

    n = F.octet_length("path")
    return changes.filter(F.col("path").isNull() | (n == 0) | (n > MAX_PATH_BYTES) | ~paths.safe("path"))


def validate_changes(changes: DataFrame, most: int | None = MAX_CHANGES) -> DataFrame:
    """The changes, if all their paths are good and there are no more than ``most``: the bound of a request; a stream's batch has none."""
    if most is not None and changes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} changes")
    if not invalid_changes(changes).isEmpty():
        raise ValueError("a change's path is empty, too long, or not absolute and normalized")
    return changes
