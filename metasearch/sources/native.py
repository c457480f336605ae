"""File records from native metadata: tables of tree items, inodes and links, or table records.

Items and inodes are parsed by built-in functions. Table records nest too deep for those: they go through Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasearch.functions.labels import mode_kind
from metasearch.operators import namespace
from metasearch.schema import as_files
from metasearch.sources import mounts

#: Item types of inodes and of their links.
INODE_ITEM, INODE_REF, INODE_EXTREF = 1, 12, 13
LARGEST = (1 << 64) - 1


def little_endian(data: Column, at: int, n: int) -> Column:
    """An unsigned number of n bytes at an offset; beyond BIGINT it is null."""
    digits = F.concat(*[F.hex(F.substring(data, at + i + 1, 1)) for i in reversed(range(n))])
    return F.conv(digits, 16, 10).cast("decimal(20,0)").try_cast("bigint")


def text_at(data: Column, at: int, n: Column) -> Column:
    return F.make_valid_utf8(F.call_function("substring", data, F.lit(at + 1), n.cast("int")).cast("string"))


# tree items


def item_links(items: DataFrame) -> DataFrame:
    """(id, parent, name, item_type, offset) of whole link items; others are left out. items: (objectid, item_type, offset, data)."""
    data, n = F.col("data"), F.octet_length("data")
    short, long_ = little_endian(data, 8, 2), little_endian(data, 16, 2)
    ref = F.when((F.col("item_type") == INODE_REF) & (n >= 10), F.when(n >= 10 + short, F.struct(F.col("offset").alias("parent"), text_at(data, 10, short).alias("name"))))
    ext = F.when((F.col("item_type") == INODE_EXTREF) & (n >= 18), F.when(n >= 18 + long_, F.struct(little_endian(data, 0, 8).alias("parent"), text_at(data, 18, long_).alias("name"))))
    return items.select(F.col("objectid").alias("id"), F.coalesce(ref, ext).alias("l"), "item_type", "offset").filter("l is not null").select("id", "l.parent", "l.name", "item_type", "offset")


def item_metas(items: DataFrame) -> DataFrame:
    """(id, size, mode, mtime) of whole inode items."""
    data = F.col("data")
    rows = items.filter((F.col("item_type") == INODE_ITEM) & (F.octet_length("data") >= 148))
    return rows.select(F.col("objectid").alias("id"), little_endian(data, 16, 8).alias("size"), little_endian(data, 52, 4).alias("mode"), little_endian(data, 136, 8).alias("mtime"))


def btrfs_files(items: DataFrame, mountpoint: str = "/") -> DataFrame:
    """One record an inode, by its first link; the root is the mountpoint itself."""
    metas = item_metas(items).dropDuplicates(["id"]).withColumn("kind", mode_kind(F.col("mode")))
    first = item_links(items).groupBy("id").agg(F.min_by(F.struct("parent", "name"), F.struct("item_type", "offset")).alias("l")).select("id", "l.parent", "l.name")
    nodes = metas.join(first, "id").withColumn("is_dir", F.col("kind") == "Dir").withColumn("parent_seq", F.lit(0)).withColumn("sequence", F.lit(0))
    prefix = mountpoint.rstrip("/")
    below = namespace.inode_paths(nodes, namespace.BTRFS_ROOT, prefix, check_sequence=False)
    root = metas.filter(F.col("id") == namespace.BTRFS_ROOT).withColumn("path", F.lit(prefix or "/")).withColumn("parent", F.lit(0).cast("long"))
    rows = below.select("path", "size", "mtime", "mode", "kind", "id", "parent").unionByName(root.select("path", "size", "mtime", "mode", "kind", "id", "parent"))
    return as_files(rows.withColumn("fs", F.lit("btrfs")).withColumnRenamed("id", "native_id").withColumnRenamed("parent", "native_parent"))


def shard_ranges(width: int = 8_000_000, n: int = 16) -> list[tuple[int, int]]:
    """Inclusive object id ranges: n of one width, and one for the rest."""
    return [(i * width, (i + 1) * width - 1) for i in range(n)] + [(n * width, LARGEST)]


def sharded(items: DataFrame, width: int = 8_000_000, n: int = 16) -> DataFrame:
    """The items with their shard (of shard_ranges), one shard a task."""
    rows = items.withColumn("shard", F.least(F.floor(F.col("objectid") / width), F.lit(n)).cast("int"))
    return rows.repartitionById(n + 1, F.col("shard"))


def shard(items: DataFrame, first: int, last: int) -> DataFrame:
    """The items of one range of object ids; over a stored table the range reaches the scan."""
    return items.filter((F.col("objectid") >= first) & (F.col("objectid") <= min(last, (1 << 63) - 1)))


def next_key(key: tuple[int, int, int]) -> tuple[int, int, int] | None:
    """The key after (object, type, offset), None after the last."""
    obj, kind, offset = key
    if offset < LARGEST:
        return obj, kind, offset + 1
    if kind < INODE_EXTREF:
        return obj, kind + 1, 0
    return (obj + 1, INODE_ITEM, 0) if obj < LARGEST else None


# inode tables with directory entries


def ext_files(inodes: DataFrame, entries: DataFrame, prefix: str = "") -> DataFrame:
    """Records of every link from inodes (id, mode, links, size_low, size_high, mtime) and entries (parent, id, name, ord).

    Free inodes are left out; only regular files have a high half of the size. The root has no record.
    """
    live = inodes.filter("mode <> 0 and links <> 0").withColumn("kind", mode_kind(F.col("mode")))
    size = F.when(F.col("kind") == "File", F.col("size_low") + F.call_function("shiftleft", F.col("size_high").cast("long"), F.lit(32))).otherwise(F.col("size_low"))
    rows = namespace.linked_paths(entries, live.withColumn("size", size).withColumn("is_dir", F.col("kind") == "Dir"), namespace.EXT_ROOT, prefix)
    return as_files(rows.withColumn("fs", F.lit("ext4")).withColumnRenamed("id", "native_id").withColumnRenamed("parent", "native_parent"))


# listed paths


def listed_files(found: DataFrame, stats: DataFrame, fs: str) -> DataFrame:
    """Records of listed paths that have a stat (path, size, mtime, mode); paths that are gone are left out. Ids are unknown."""
    rows = found.join(stats, "path").withColumn("kind", mode_kind(F.col("mode"))).withColumn("fs", F.lit(fs))
    return as_files(rows)


# master file table


@dataclass(frozen=True)
class Geometry:
    sector: int
    cluster: int
    record: int
    table: int


def geometry(boot: bytes) -> Geometry:
    if boot[3:7] != b"NTFS":
        raise ValueError("no NTFS boot sector")
    sector, per_cluster = struct.unpack_from("<HB", boot, 11)
    if not sector or sector & (sector - 1) or not per_cluster:
        raise ValueError("invalid geometry")
    cluster, size = sector * per_cluster, struct.unpack_from("<b", boot, 64)[0]
    record = 1 << -size if size < 0 else cluster * size
    if not sector <= record <= 1 << 16:
        raise ValueError("invalid record size")
    return Geometry(sector, cluster, record, struct.unpack_from("<Q", boot, 48)[0] * cluster)


def runs(data: bytes, cluster: int) -> list[tuple[int, int, int]]:
    """(logical, length, physical) in bytes from a run list."""
    found, at, place, logical = [], 0, 0, 0
    while at < len(data) and data[at]:
        a, b = data[at] & 15, data[at] >> 4
        part = data[at + 1 : at + 1 + a + b]
        if not 1 <= a <= 8 or not 1 <= b <= 8 or len(part) < a + b:
            raise ValueError("invalid run")
        place += int.from_bytes(part[a:], "little", signed=True)
        if place < 0:
            raise ValueError("a run before the volume")
        size = int.from_bytes(part[:a], "little") * cluster
        found.append((logical, size, place * cluster))
        logical, at = logical + size, at + 1 + a + b
    return found


def fixed_up(record: bytes, sector: int) -> bytes | None:
    """The record with the last bytes of its sectors restored; None if they don't fit."""
    at, count = struct.unpack_from("<HH", record, 4)
    if not sector or len(record) % sector or count != len(record) // sector + 1 or at + 2 * count > len(record):
        return None
    whole, mark = bytearray(record), record[at : at + 2]
    for i in range(1, count):
        end = i * sector
        if record[end - 2 : end] != mark:
            return None
        whole[end - 2 : end] = record[at + 2 * i : at + 2 * i + 2]
    return bytes(whole)


def unix_time(filetime: int) -> int:
    return filetime // 10_000_000 - 11_644_473_600


def attributes(record: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, bytes) of a record's attributes."""
    at = struct.unpack_from("<H", record, 20)[0]
    while at + 16 <= len(record):
        kind, size = struct.unpack_from("<II", record, at)
        if kind == 0xFFFFFFFF or size < 16 or at + size > len(record):
            return
        yield kind, record[at : at + size]
        at += size


def table_runs(record: bytes, cluster: int) -> tuple[list[tuple[int, int, int]], int]:
    """Runs and size of the table itself, from its first record."""
    for kind, a in attributes(record):
        if kind == 0x80 and a[8] and not a[9]:
            at = struct.unpack_from("<H", a, 32)[0]
            if len(a) < 64 or not 64 <= at <= len(a):
                raise ValueError("invalid run list")
            return runs(a[at:], cluster), struct.unpack_from("<Q", a, 48)[0]
    raise ValueError("the table has no data attribute")


def parsed(number: int, record: bytes, sector: int) -> dict | None:
    """What a record in use says: flags, times, size, and its names in order; None if it says nothing."""
    if record[:4] != b"FILE" or not struct.unpack_from("<H", record, 22)[0] & 1:
        return None
    record = fixed_up(record, sector)
    if record is None:
        return None
    mtime, size, names, folder = 0, None, [], False
    for kind, a in attributes(record):
        plain = not a[9]
        if a[8]:
            if kind == 0x80 and plain and len(a) >= 64:
                size = struct.unpack_from("<Q", a, 48)[0]
            continue
        n, at = struct.unpack_from("<I", a, 16)[0], struct.unpack_from("<H", a, 20)[0]
        if at + n > len(a):
            continue
        v = a[at : at + n]
        if kind == 0x80 and plain:
            size = n
        elif kind == 0x10 and n >= 16:
            mtime = unix_time(struct.unpack_from("<Q", v, 8)[0])
        elif kind == 0x30 and n >= 66 and 66 + 2 * v[64] <= n:
            name = v[66 : 66 + 2 * v[64]].decode("utf-16-le", "replace")
            if name not in (".", ".."):
                parent = struct.unpack_from("<Q", v, 0)[0]
                names.append({"parent": parent & (1 << 48) - 1, "parent_seq": parent >> 48, "name": name, "namespace": v[65], "ord": len(names), "size": struct.unpack_from("<Q", v, 48)[0], "dir": bool(struct.unpack_from("<I", v, 56)[0] & 0x10000000)})
    if not names:
        return None
    base = struct.unpack_from("<Q", record, 32)[0]
    return {"id": number, "sequence": struct.unpack_from("<H", record, 16)[0], "base_id": base & (1 << 48) - 1, "base_seq": base >> 48, "header_dir": bool(struct.unpack_from("<H", record, 22)[0] & 2), "mtime": mtime, "size": size, "names": names}


NAMES = pa.list_(pa.struct([("parent", pa.int64()), ("parent_seq", pa.int64()), ("name", pa.string()), ("namespace", pa.int64()), ("ord", pa.int64()), ("size", pa.int64()), ("dir", pa.bool_())]))
PARSED = pa.schema([("id", pa.int64()), ("sequence", pa.int64()), ("base_id", pa.int64()), ("base_seq", pa.int64()), ("header_dir", pa.bool_()), ("mtime", pa.int64()), ("size", pa.int64()), ("names", NAMES)])
PARSED_DDL = "id bigint, sequence bigint, base_id bigint, base_seq bigint, header_dir boolean, mtime bigint, size bigint, names array<struct<parent: bigint, parent_seq: bigint, name: string, namespace: bigint, ord: bigint, size: bigint, dir: boolean>>"


def parse_records(records: DataFrame, sector: int = 512) -> DataFrame:
    """Parsed rows from (number, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (parsed(n, d, sector) for n, d in zip(batch.column("number").to_pylist(), batch.column("data").to_pylist(), strict=True))
            yield pa.RecordBatch.from_pylist([r for r in rows if r], schema=PARSED)

    return records.select("number", "data").mapInArrow(run, PARSED_DDL)


def ntfs_files(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Records from parsed rows: the best name of each base record with the largest size among its parts, and one more for each other name of a file."""
    each = rows.select("id", "base_id", "base_seq", F.explode("names").alias("n")).select("id", "base_id", "base_seq", "n.*")
    own = each.filter("base_id = 0")
    rank = F.when(F.col("namespace").isin(1, 3), 3).when(F.col("namespace") == 0, 2).when(F.col("namespace") == 2, 1).otherwise(0)
    best = own.groupBy("id").agg(F.max_by(F.struct("parent", "parent_seq", "name", "size", "dir"), F.struct(rank, -F.col("ord"))).alias("b"))
    base = rows.filter("base_id = 0").join(best, "id").select("id", "sequence", F.col("b.parent").alias("parent"), F.col("b.parent_seq").alias("parent_seq"), F.col("b.name").alias("name"), (F.col("header_dir") | F.col("b.dir")).alias("is_dir"), F.coalesce("size", "b.size").alias("size"), "mtime")
    parts = rows.filter("base_id <> 0").join(each.filter("base_id <> 0").groupBy("id").agg(F.max_by("size", F.struct(rank, -F.col("ord"))).alias("_named")), "id")
    fits = lambda: (F.col("base_seq") == 0) | (F.col("base_seq") == F.col("sequence"))
    larger = parts.select(F.col("base_id").alias("_b"), "base_seq", F.coalesce("size", "_named").alias("_size")).join(base.select(F.col("id").alias("_b"), "sequence"), "_b").filter(fits()).groupBy("_b").agg(F.max("_size").alias("_size"))
    inodes = base.join(larger, F.col("id") == F.col("_b"), "left").withColumn("size", F.greatest("size", "_size")).drop("_b", "_size")
    more = each.filter("base_id <> 0").select(F.col("base_id").alias("id"), "base_seq", "parent", "parent_seq", "name").join(base.select("id", "sequence"), "id").filter(fits()).select("id", "parent", "parent_seq", "name")
    aliases = own.filter("namespace <> 2").select("id", "parent", "parent_seq", "name").unionByName(more).dropDuplicates(["id", "parent", "name"]).join(base.select("id", "parent", "name"), ["id", "parent", "name"], "left_anti")
    # an alias hangs on its parent under that parent's sequence
    known = inodes.select(F.col("id").alias("_p"), F.col("sequence").alias("_s"))
    aliases = aliases.join(known, F.col("parent") == F.col("_p"), "left").filter((F.col("parent_seq") == 0) | (F.col("_s") == F.col("parent_seq"))).select("id", "parent", "name")
    main = namespace.as_records(namespace.inode_paths(inodes, namespace.NTFS_ROOT, prefix), "ntfs")
    return main.unionByName(namespace.as_records(namespace.alias_paths(aliases, inodes, namespace.NTFS_ROOT, prefix), "ntfs"))


def image_records(spark: SparkSession, path: str, per_task: int = 4096) -> DataFrame:
    """(number, data) of an image's table. The driver reads the boot sector and the run list; tasks read their records, so the
    path must be one that all executors see."""
    with open(path, "rb") as f:
        g = geometry(f.read(512))
        f.seek(g.table)
        first = fixed_up(f.read(g.record), g.sector)
    if first is None:
        raise ValueError("the table's first record is damaged")
    where, size = table_runs(first, g.cluster)
    total = size // g.record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                for start in batch.column("start").to_pylist():
                    rows = []
                    for number in range(start, min(start + per_task, total)):
                        data, at = b"", number * g.record
                        for logical, length, physical in where:
                            if logical <= at < logical + length and len(data) < g.record:
                                f.seek(physical + at - logical)
                                part = f.read(min(g.record - len(data), logical + length - at))
                                data, at = data + part, at + len(part)
                        rows.append((number, data))
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["number", "data"])

    starts = spark.range(0, total, per_task).withColumnRenamed("id", "start")
    return starts.mapInArrow(run, "number bigint, data binary")


#: From the tables of a scan (by name) to file records, by the reader's name.
LANES = {
    "btrfs_files": lambda tables, prefix: btrfs_files(tables["items"], prefix or "/"),
    "ext_files": lambda tables, prefix: ext_files(tables["inodes"], tables["entries"], prefix),
    "ntfs_files": lambda tables, prefix: ntfs_files(parse_records(tables["records"]), prefix),
}


def scan(label: str, tables: dict[str, DataFrame], prefix: str = "") -> DataFrame:
    """File records of one filesystem by its label, from its tables: items (btrfs), inodes and entries (ext4), records (ntfs)."""
    return LANES[mounts.lane(label)](tables, prefix)
