"""Schemas of the file catalog and of the tables it is made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from metasearch.functions import paths


def _schema(text: str) -> StructType:
    kinds = {"s": StringType(), "l": LongType(), "b": BooleanType()}
    return StructType([StructField(name, kinds[kind], True) for name, kind in (x.split(":") for x in text.split())])


FILE_SCHEMA = _schema("path:s size:l mtime:l mode:l kind:s fs:s native_id:l native_parent:l source:l")
CHANGE_SCHEMA = _schema("seq:l batch_id:l op:s path:s size:l mtime:l mode:l kind:s fs:s native_id:l native_parent:l source:l")
MOUNT_SCHEMA = _schema("device:s mountpoint:s fs:s source_kind:s host:s")
INODE_SCHEMA = _schema("id:l parent:l parent_seq:l sequence:l name:s is_dir:b size:l mtime:l")
LINK_SCHEMA = _schema("parent:l id:l name:s")
FILE_COLUMNS = FILE_SCHEMA.fieldNames()
#: Stored beside the columns above: paths.key(path).
KEY = "path_key"
STORED_SCHEMA = StructType([*FILE_SCHEMA.fields, StructField(KEY, StringType(), True), StructField("block_id", LongType(), True)])

#: Values of fields that a source doesn't give.
DEFAULTS = {"size": 0, "mtime": 0, "mode": 0, "kind": "File", "fs": "ext4", "native_id": 0, "native_parent": 0, "source": 0}


def as_files(df: DataFrame) -> DataFrame:
    """The columns of FILE_SCHEMA in order; missing ones get their defaults, others go. ``path`` must be there."""
    if "path" not in df.columns:
        raise ValueError("a file table needs a path column")
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(DEFAULTS[f.name])).cast(f.dataType).alias(f.name) for f in FILE_SCHEMA])


def check(df: DataFrame, schema: StructType) -> DataFrame:
    """The rows, if names and types are those of the schema."""
    got, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if got != want:
        raise ValueError(f"schema mismatch: {got} for {want}")
    return df


def named(df: DataFrame) -> DataFrame:
    """Adds the derived columns name and ext."""
    return df.withColumn("name", paths.name(F.col("path"))).withColumn("ext", paths.extension(F.col("path")))


def with_key(files: DataFrame) -> DataFrame:
    """The stored form of a file table."""
    return as_files(files).withColumn(KEY, paths.key("path"))
