"""Shards by jump consistent hashing, in SQL expressions only.

The hash walks the jumps of a key (a 64-bit linear congruential generator) until a jump passes the shard count; with one more shard a
row either stays or goes to the new one. Nothing but the key and the count decides.

Defined results: a null key counts as 0; a null text has no bytes; repeated rows each get a slot of their own; an empty table gives no
rows. Slots in a shard follow (chunk of the key, key, size, checksum), so equal input gives equal slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
#: Slots are counted in so many parts a shard, so that no task sorts a whole shard.
CHUNKS = 1024
#: Copies of one row are dealt out in runs of at most this many.
RUN = 1 << 16

LOW = (1 << 32) - 1


def next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, from products that never pass 2**63 (ANSI mode raises on overflow)."""
    m0, m1, m2, m3 = (MULTIPLIER >> s & 0xFFFF for s in (0, 16, 32, 48))
    lo, hi = key.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(key, 32)

    def half(x: Column, low: int, high: int) -> Column:
        return (x * low).bitwiseAND(F.lit(LOW)) + F.shiftleft((x * high).bitwiseAND(F.lit(0xFFFF)), 16)

    lower = half(lo, m0, m1) + 1
    upper = F.shiftrightunsigned(lo * m0, 32) + F.shiftrightunsigned(lo * m1, 16) + half(lo, m2, m3) + half(hi, m0, m1) + F.shiftrightunsigned(lower, 32)
    return F.shiftleft(upper.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(lower.bitwiseAND(F.lit(LOW)))


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among ``shards``, and among one more. One walk gives both."""
    start = F.struct(key.cast("long").alias("key"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("shard"), F.lit(0).alias("grown"))

    def step(at: Column, _: Column) -> Column:
        key = next_key(at["key"])
        # each step's key is needed twice: bind it once
        return F.transform(F.array(key), lambda k: F.struct(
            k.alias("key"),
            F.floor((at["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1))).cast("long").alias("j"),
            F.when(at["j"] < shards, at["j"].cast("int")).otherwise(at["shard"]).alias("shard"),
            at["j"].cast("int").alias("grown"),
        ))[0]

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, lambda at, i: F.when(at["j"] <= shards, step(at, i)).otherwise(at))
    return F.transform(F.array(walked), lambda w: F.struct(w["shard"].alias("shard"), w["grown"].alias("grown")))[0]


def string_key(column: Column) -> Column:
    """A long key of any value, for tables whose keys are not longs."""
    return F.xxhash64(column)


def jump_shards(rows: DataFrame, key: Column, shards: int, name: str = "_jump") -> DataFrame:
    """The rows with ``name``: struct(shard int, grown int)."""
    return rows.withColumn(name, jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")), shards))


def shard_table(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = jump_shards(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), id_, shards)
    rows = rows.select("doc_id", "size", "text_crc32", F.col("_jump.shard").alias("shard"), F.col("_jump.grown").alias("grown_shard"), F.shiftrightunsigned(next_key(id_), 22).bitwiseAND(F.lit(CHUNKS - 1)).cast("int").alias("_chunk"))
    copies = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    # shards x CHUNKS rows at most, whatever the table's size
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = copies.groupBy("shard", "_chunk").agg(F.sum("_copies").alias("_n")).select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("shard", "_chunk").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("_in", F.coalesce(F.sum("_copies").over(inner), F.lit(0))).join(F.broadcast(starts), ["shard", "_chunk"])
    runs = placed.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / RUN))))
    slots = runs.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(RUN).cast("long"), F.col("_copies") - F.col("_run") * RUN) - 1)))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_in") + F.col("_run") * RUN + F.col("_i")).alias("slot"), "grown_shard")
