"""Derived tables: one SQL text each, for Spark and for DuckDB. {EPOCH:x} is the one difference."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURES = {
    "files_part": r"""
select concat('/parts/', replace(p_brand,'#','-'), '/', p_type, '/', p_name, '-', cast(p_partkey as string),
         case cast(p_partkey % 7 as int) when 0 then '.rs' when 1 then '.toml' when 2 then '.jpg' when 3 then '.TXT'
              when 4 then '.so' when 5 then '.json' else '' end) as path,
       cast(p_size as bigint) * 65536 as size,
       cast(1700000000 + (p_partkey * 37) % 1000000 as bigint) as mtime,
       cast(33188 as bigint) as mode,
       case cast(p_partkey % 11 as int) when 0 then 'Symlink' when 1 then 'Other' else 'File' end as kind,
       case cast(p_partkey % 5 as int) when 0 then 'btrfs' when 1 then 'ext4' when 2 then 'ntfs' when 3 then 'zfs' else 'net:smb3' end as fs,
       p_partkey as native_id, cast(0 as bigint) as native_parent, cast(p_partkey % 3 as bigint) as source
from part
""",
    "dirs_part": r"""
select path, cast(0 as bigint) as size, cast(1700000000 as bigint) as mtime, cast(16877 as bigint) as mode, 'Dir' as kind,
       'ext4' as fs, cast(0 as bigint) as native_id, cast(0 as bigint) as native_parent, cast(0 as bigint) as source
from (select '/parts' as path union select concat('/parts/', replace(p_brand,'#','-')) from part
      union select concat('/parts/', replace(p_brand,'#','-'), '/', p_type) from part) d
""",
    "files_orders": r"""
select concat('/orders/', cast(year(o_orderdate) as string), '/', o_orderstatus, '/order-', cast(o_orderkey as string), '.csv') as path,
       cast(floor(o_totalprice) as bigint) as size, {EPOCH:o_orderdate} as mtime, cast(33188 as bigint) as mode, 'File' as kind,
       'btrfs' as fs, o_orderkey as native_id, o_custkey as native_parent, cast(0 as bigint) as source
from orders
""",
    "files_docs": r"""
select concat('/corpus/', source, '/', lang, '/doc-', cast(doc_id as string), '.txt') as path, n_chars as size,
       cast(1700000000 + doc_id as bigint) as mtime, cast(33188 as bigint) as mode, 'File' as kind, 'ext4' as fs,
       doc_id as native_id, cast(0 as bigint) as native_parent, cast(0 as bigint) as source
from documents
""",
    "files_pages": r"""
select concat('//', regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*', '')) as path, cast(length(html) as bigint) as size,
       cast(1700000000 + page_id as bigint) as mtime, cast(0 as bigint) as mode, 'File' as kind, 'net:nfs4' as fs,
       page_id as native_id, cast(0 as bigint) as native_parent, cast(7 as bigint) as source
from pages
""",
    "changes_events": r"""
select e.event_id as seq, cast(e.event_id % 16 as bigint) as batch_id,
       case e.event_type when 'error' then 'Remove' else 'Upsert' end as op,
       case e.event_type when 'signup' then concat(f.path, '.new') else f.path end as path,
       case e.event_type when 'error' then null else cast(floor(e.value * 1024) as bigint) end as size,
       case e.event_type when 'error' then null else {EPOCH:e.ts} end as mtime
from events e join (select concat('/parts/', replace(p_brand,'#','-'), '/', p_type, '/', p_name, '-', cast(p_partkey as string),
         case cast(p_partkey % 7 as int) when 0 then '.rs' when 1 then '.toml' when 2 then '.jpg' when 3 then '.TXT'
              when 4 then '.so' when 5 then '.json' else '' end) as path, p_partkey from part) f on f.p_partkey = e.user_id
""",
    "inode_tree": r"""
select cast(10 + r_regionkey as bigint) as id, cast(5 as bigint) as parent, cast(0 as bigint) as parent_seq, cast(1 as bigint) as sequence,
       r_name as name, true as is_dir, cast(0 as bigint) as size from region
union all select cast(100 + n_nationkey as bigint), cast(10 + n_regionkey as bigint), cast(1 as bigint), cast(1 as bigint), n_name, true, cast(0 as bigint) from nation
union all select cast(1000000 + c_custkey as bigint), cast(100 + c_nationkey as bigint),
       cast(case when c_custkey % 97 = 0 then 2 else 1 end as bigint), cast(1 as bigint), c_name, true, cast(0 as bigint) from customer
union all select cast(100000000 + o_orderkey as bigint), cast(1000000 + o_custkey as bigint), cast(1 as bigint), cast(1 as bigint),
       concat('order-', cast(o_orderkey as string), '.csv'), false, cast(floor(o_totalprice) as bigint) from orders
""",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(name: str) -> str:
    """The fixture as DuckDB SQL."""
    return re.sub(r"\{EPOCH:([^}]*)\}", r"cast(floor(epoch(\1)) as bigint)", FIXTURES[name]).strip()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame over the tables of ``sf_dir``."""
    text = re.sub(r"\{EPOCH:([^}]*)\}", r"unix_seconds(cast(\1 as timestamp))", FIXTURES[name])
    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


# native metadata, as bytes made from the tables


def number(value: Column | int, n: int) -> Column:
    """n little-endian bytes."""
    digits = F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(n)]))


def zeros(n: int) -> Column:
    return F.unhex(F.lit("00" * n))


def tree_items(tree: DataFrame, root: int) -> DataFrame:
    """(objectid, item_type, offset, data): an inode item and a link item for each row of an inode tree, and the root's."""
    mode = F.when(F.col("is_dir"), 0o040755).otherwise(0o100644)
    inode = F.concat(zeros(16), number(F.col("size"), 8), zeros(28), number(mode, 4), zeros(80), number(F.col("id") + 7, 8), zeros(16))
    name = F.encode("name", "utf-8")
    rows = tree.withColumn("size", F.col("size").cast("long"))
    top = tree.sparkSession.range(1).select(F.lit(root).cast("long").alias("id"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"))
    metas = rows.select("id", "is_dir", "size").unionByName(top).select(F.col("id").alias("objectid"), F.lit(1).alias("item_type"), F.lit(0).cast("long").alias("offset"), inode.alias("data"))
    links = rows.select(F.col("id").alias("objectid"), F.lit(12).alias("item_type"), F.col("parent").alias("offset"), F.concat(zeros(8), number(F.octet_length(name), 2), name).alias("data"))
    return metas.unionByName(links)


def table_records(tree: DataFrame) -> DataFrame:
    """(number, data): a table record of 1024 bytes for each row of an inode tree, with a standard and a file name attribute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [table_record(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("parent", "parent_seq", "sequence", "name", "is_dir", "size")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["number", "data"])

    return tree.select("id", "parent", "parent_seq", "sequence", "name", "is_dir", "size").mapInArrow(run, "number bigint, data binary")


def table_record(parent: int, parent_seq: int, sequence: int, name: str, is_dir: bool, size: int) -> bytes:
    text = name.encode("utf-16-le")
    names = struct.pack("<Q", parent | parent_seq << 48) + bytes(40) + struct.pack("<QII", size, 0x10000000 if is_dir else 0, 0) + bytes([len(name), 3]) + text
    times = bytes(8) + struct.pack("<Q", (1_700_000_000 + 11_644_473_600) * 10_000_000) + bytes(16)
    body = b"".join(attribute(kind, value) for kind, value in ((0x10, times), (0x30, names))) + b"\xff\xff\xff\xff"
    data = bytearray(b"FILE" + struct.pack("<HH", 48, 3) + bytes(8) + struct.pack("<HHHH", sequence, 1, 56, 3 if is_dir else 1) + bytes(32) + body)
    data += bytes(1024 - len(data))
    marks = b"\x07\x00" + bytes(data[510:512]) + bytes(data[1022:1024])
    data[510:512] = data[1022:1024] = b"\x07\x00"
    data[48:54] = marks
    return bytes(data)


def attribute(kind: int, value: bytes) -> bytes:
    body = struct.pack("<BBHHHIHH", 0, 0, 24, 0, 0, len(value), 24, 0) + value
    body += bytes(-len(body) % 8)
    return struct.pack("<II", kind, len(body) + 8) + body


def event_buffers(changes: DataFrame) -> DataFrame:
    """(seq, data): one kernel event a change, with the place and name of what was created or deleted."""
    name = F.concat(F.encode(F.element_at(F.split("path", "/"), -1), "utf-8"), zeros(1))
    place = F.concat(zeros(8), number(8, 4), zeros(4), number(F.col("seq"), 8), name)  # file system, handle, name
    info = F.concat(number(2, 1), zeros(1), number(F.octet_length(place) + 4, 2), place)
    mask = F.when(F.col("op") == "Remove", 0x200).otherwise(0x108)
    head = lambda size: F.concat(number(size, 4), number(3, 1), zeros(1), number(24, 2), number(mask, 8), zeros(8))
    return changes.select("seq", F.concat(head(F.octet_length(info) + 24), info).alias("data"))
