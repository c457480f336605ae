"""Text that operating systems print, as tables. Inputs are DataFrames with one line in ``value`` (spark.read.text)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasearch.functions import labels


def read_nul_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths between NUL characters; line ends stay part of them."""
    return nul_paths(spark.read.option("lineSep", "\0").text(path))


def nul_paths(lines: DataFrame) -> DataFrame:
    """Drops what is empty or no valid UTF-8."""
    return lines.filter((F.col("value") != "") & F.is_valid_utf8("value")).select(F.col("value").alias("path"))


def split_nul(data: DataFrame) -> DataFrame:
    """The same from whole buffers in ``value`` (string)."""
    return nul_paths(data.select(F.explode(F.split("value", "\\x00")).alias("value")))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("\\040"), F.lit(" "))


def mountinfo(lines: DataFrame) -> DataFrame:
    """Supported mounts of the kernel's table, by mountpoint from the last to the first; network mounts need a host."""
    at = F.call_function("instr", F.col("value"), F.lit(" - "))
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    rows = lines.filter(at > 0).select(words(F.substring("value", F.lit(1), at - 1)).alias("pre"), words(F.substring(F.col("value"), at + 3, F.length("value"))).alias("post"))
    rows = rows.filter((F.size("pre") >= 5) & (F.size("post") >= 2)).select(unescape(F.col("post")[1]).alias("device"), unescape(F.col("pre")[4]).alias("mountpoint"), F.col("post")[0].alias("_type"))
    rows = rows.filter(labels.is_supported(F.col("_type"))).withColumn("fs", labels.fs_label_of(F.col("_type"))).drop("_type")
    remote = F.startswith("fs", F.lit("net:"))
    rows = rows.withColumn("source_kind", F.when(remote, "Remote").otherwise("Local")).withColumn("host", F.when(remote, labels.network_host(F.col("device"))))
    return rows.filter(~remote | F.col("host").isNotNull()).orderBy(F.desc("mountpoint"))


def mac_mounts(lines: DataFrame) -> DataFrame:
    """apfs and hfs volumes from ``mount`` output, without the system's own."""
    part = lambda i: F.regexp_extract("value", r"^(.*?) on (.*) \(([^()]*)\)*$", i)
    rows = lines.select(part(1).alias("device"), part(2).alias("mountpoint"), F.trim(F.substring_index(part(3), ",", 1)).alias("fs"))
    return rows.filter(F.col("fs").isin("apfs", "hfs") & ~F.startswith("mountpoint", F.lit("/System/Volumes/")))


def zfs_diff(lines: DataFrame) -> DataFrame:
    """(line, change, path, to_path) from ``zfs diff`` lines (line number from 1 in ``line``); an unknown mark or missing path raises with its line.

    Three columns or more hold a type before the path.
    """
    cols = F.split("value", "\t")
    mark, at = F.trim(cols[0]), F.when(F.size(cols) >= 3, 2).otherwise(1)
    name = F.when(mark == "+", "Created").when(mark == "-", "Removed").when(mark == "M", "Modified").when(mark == "R", "Renamed")
    bad = lambda what: F.raise_error(F.concat(F.lit(f"{what} on line "), F.col("line").cast("string"))).cast("string")
    path = lambda i: F.coalesce(F.get(cols, i), bad("no path"))
    return lines.filter(F.trim("value") != "").select(
        "line", F.coalesce(name, bad("unknown mark")).alias("change"), path(at).alias("path"), F.when(mark == "R", path(at + 1)).alias("to_path"))


def zfs_changes(diff: DataFrame) -> DataFrame:
    """(line, op, path): what a diff means for a catalog; a rename removes and adds."""
    both = F.when(F.col("change") == "Renamed", F.array(F.struct(F.lit("Remove").alias("op"), F.col("path").alias("path")), F.struct(F.lit("Upsert").alias("op"), F.col("to_path").alias("path"))))
    one = F.array(F.struct(F.when(F.col("change") == "Removed", "Remove").otherwise("Upsert").alias("op"), F.col("path").alias("path")))
    return diff.select("line", F.explode(F.coalesce(both, one)).alias("c")).select("line", "c.op", "c.path")


SNAPSHOT_PREFIX = "metasearch-"


def snapshot_name(dataset: str, unix_seconds: int) -> str:
    if not dataset or "@" in dataset or re.search(r"\s", dataset):
        raise ValueError("invalid dataset name")
    return f"{dataset}@{SNAPSHOT_PREFIX}{unix_seconds}"


def snapshot_command(dataset: str, unix_seconds: int, recursive: bool = False) -> list[str]:
    return ["snapshot", *["-r"] * recursive, snapshot_name(dataset, unix_seconds)]


def is_own_snapshot(name: str) -> bool:
    return name.rpartition("@")[2].startswith(SNAPSHOT_PREFIX) and "@" in name


def destroy_command(snapshot: str) -> list[str]:
    if not is_own_snapshot(snapshot):
        raise ValueError("not one of our snapshots")
    return ["destroy", snapshot]
