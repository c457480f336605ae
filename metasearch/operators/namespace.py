"""Absolute paths from parent pointers.

Directories are resolved by pointer doubling: each round replaces a directory's pointer by its target's, so a tree of depth d takes log2(d)
joins of the directory table and no level is walked by the driver. Cycles and orphans never reach the root and are left out. Files join
once, at the end.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasearch.checkpoints import cut
from metasearch.functions import paths
from metasearch.functions.labels import mode_kind
from metasearch.schema import as_files

#: Root ids of the filesystems.
BTRFS_ROOT, EXT_ROOT, NTFS_ROOT = 256, 2, 5


def checked_links(inodes: DataFrame, root: int) -> DataFrame:
    """Rows whose parent has the sequence that they expect (0 expects nothing). The root's own row is left out."""
    rows, known = inodes.filter(F.col("id") != root), inodes.select(F.col("id").alias("_p"), F.col("sequence").alias("_s"))
    joined = rows.join(known, F.col("parent") == F.col("_p"), "left")
    return joined.filter((F.col("parent_seq") == 0) | (F.col("_s") == F.col("parent_seq"))).drop("_p", "_s")


def directory_paths(dirs: DataFrame, root: int) -> DataFrame:
    """(id, path) below the root ('' for itself) from one (id, parent, name) a directory."""
    top = dirs.sparkSession.range(1).select(F.lit(root).cast("long").alias("id"), F.lit("").alias("path"))
    state = cut(dirs.filter(F.col("id") != root).select("id", F.col("parent").alias("to"), F.col("name").alias("path")).dropDuplicates(["id"]))
    waiting = None
    while True:
        arrived, open_ = state.filter(F.col("to") == root), state.filter(F.col("to") != root)
        up = state.select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("path").alias("_path"))
        # a target passes on its own pointer, at last the root; a missing one drops what points at it. What has arrived meets nobody any more.
        step = open_.join(up, F.col("to") == F.col("_id")).select("id", F.col("_to").alias("to"), paths.append_component(F.col("_path"), F.col("path")).alias("path"))
        state = cut(arrived.unionByName(step))
        # cycles never arrive; when nobody new did, nobody will
        n = state.agg(F.count_if(F.col("to") != root).alias("open"), F.count(F.lit(1)).alias("all")).first()
        if n["open"] == 0 or n == waiting:
            return top.unionByName(state.filter(F.col("to") == root).select("id", "path"))
        waiting = n


def full_path(prefix: str, relative: Column) -> Column:
    return F.concat(F.lit(prefix.rstrip("/\\") + "/"), relative)


def inode_paths(inodes: DataFrame, root: int = NTFS_ROOT, prefix: str = "", check_sequence: bool = True) -> DataFrame:
    """The rows that hang on the root, with path; inodes have one parent each. The root itself is left out."""
    rows = checked_links(inodes, root) if check_sequence else inodes.filter(F.col("id") != root)
    folders = directory_paths(rows.filter("is_dir"), root).select(F.col("id").alias("_p"), F.col("path").alias("_dir"))
    return rows.join(folders, F.col("parent") == F.col("_p")).withColumn("path", full_path(prefix, paths.append_component(F.col("_dir"), F.col("name")))).drop("_p", "_dir")


def as_records(rows: DataFrame, fs: str) -> DataFrame:
    """File records of resolved inodes."""
    kind = F.when(F.col("is_dir"), "Dir").otherwise("File") if "is_dir" in rows.columns else mode_kind(F.col("mode"))
    return as_files(rows.withColumn("kind", kind).withColumn("fs", F.lit(fs)).withColumnRenamed("id", "native_id").withColumnRenamed("parent", "native_parent"))


def first_links(items: DataFrame) -> DataFrame:
    """One (id, parent, name) an inode: its first link by ``ord``."""
    first = items.groupBy("id").agg(F.min_by(F.struct("parent", "name"), "ord").alias("l"))
    return first.select("id", F.col("l.parent").alias("parent"), F.col("l.name").alias("name"))


def best_names(names: DataFrame) -> DataFrame:
    """One (id, parent, name) a record from its names by namespace: Win32 before POSIX before DOS; the first of equals."""
    rank = F.when(F.col("namespace").isin(1, 3), 3).when(F.col("namespace") == 0, 2).when(F.col("namespace") == 2, 1).otherwise(0)
    best = names.filter(~F.col("name").isin(".", "..")).groupBy("id").agg(F.max_by(F.struct("parent", "name"), F.struct(rank, -F.col("ord"))).alias("b"))
    return best.select("id", F.col("b.parent").alias("parent"), F.col("b.name").alias("name"))


def extra_names(names: DataFrame) -> DataFrame:
    """(id, parent, name) of the other names that are no DOS names: one more record each."""
    best = best_names(names)
    return names.filter((F.col("namespace") != 2) & ~F.col("name").isin(".", "..")).select("id", "parent", "name").distinct().join(best, ["id", "parent", "name"], "left_anti")


def merge_extensions(records: DataFrame) -> DataFrame:
    """Base records (base_id 0) with the largest size among them and their extension records, if the sequence fits (0 fits all)."""
    parts = records.filter("base_id <> 0").select(F.col("base_id").alias("_b"), "base_seq", F.col("size").alias("_size"))
    base = records.filter("base_id = 0").select("id", "sequence", "size")
    joined = base.join(parts, (F.col("id") == F.col("_b")) & ((F.col("base_seq") == 0) | (F.col("base_seq") == F.col("sequence"))), "left")
    return joined.groupBy("id", "sequence").agg(F.greatest(F.first("size"), F.coalesce(F.max("_size"), F.lit(0))).alias("size"))


def alias_paths(aliases: DataFrame, inodes: DataFrame, root: int = NTFS_ROOT, prefix: str = "") -> DataFrame:
    """One row for each further name (id, parent, name) of a file; directories have none."""
    folders = directory_paths(checked_links(inodes, root).filter("is_dir"), root).select(F.col("id").alias("_p"), F.col("path").alias("_dir"))
    rows = aliases.join(inodes.filter("not is_dir").drop("parent", "name"), "id").join(folders, F.col("parent") == F.col("_p"))
    return rows.withColumn("path", full_path(prefix, paths.append_component(F.col("_dir"), F.col("name")))).drop("_p", "_dir")


def linked_paths(links: DataFrame, inodes: DataFrame, root: int = EXT_ROOT, prefix: str = "") -> DataFrame:
    """A row for every link (parent, id, name, ord) that the root reaches; a directory with several names is opened under the first only.

    First means breadth first, then by ``ord`` along the way. Directories are few beside files, so only they are walked.
    """
    links = links.filter(~F.col("name").isin("", ".", ".."))
    dirs = links.join(inodes.filter("is_dir").select("id"), "id", "left_semi")
    level = links.sparkSession.range(1).select(F.lit(root).cast("long").alias("id"), F.lit("").alias("dir"), F.array().cast("array<bigint>").alias("way"))
    levels = [level]
    while True:
        opened = functools.reduce(DataFrame.unionByName, levels)
        step = dirs.withColumnRenamed("id", "child").join(level.withColumnRenamed("id", "at"), F.col("parent") == F.col("at"))
        step = step.select(F.col("child").alias("id"), paths.append_component(F.col("dir"), F.col("name")).alias("dir"), F.concat("way", F.array("ord")).alias("way"))
        first = step.groupBy("id").agg(F.min_by("dir", "way").alias("dir"), F.min("way").alias("way")).join(opened.select("id"), "id", "left_anti")
        level = cut(first)
        if level.isEmpty():
            break
        levels.append(level)
    folders = opened.select(F.col("id").alias("_p"), "dir")
    rows = links.join(folders, F.col("parent") == F.col("_p")).join(inodes.drop("parent", "name"), "id")
    return rows.withColumn("path", full_path(prefix, paths.append_component(F.col("dir"), F.col("name")))).drop("_p", "dir")
