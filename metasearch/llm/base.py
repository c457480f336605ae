"""Shared pieces: tables, row keys, checkpoints, word hashes, a bounded Bloom pre-filter."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes whose words are hashed at a time.
WORDS_PIECE = 1 << 16
#: Rows of text in one Arrow batch, unless the session asks for fewer.
BATCH_ROWS = 1000
#: Most 64-bit words of a broadcast Bloom filter (16 MB), and words in one of its rows.
BLOOM_WORDS, BLOOM_ROW = 1 << 21, 1 << 10
#: Bytes of text for each task of an exchange, where that makes more tasks than the session's setting.
TASK_BYTES = 64 << 20

U64 = np.uint64
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

M1_INVERSE = U64(pow(int(M1), -1, 1 << 64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long: fewer rows in an Arrow batch keep the memory of executors and their Python workers low."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as long, text, and ``_k``, which with doc_id tells rows apart (repeats of a whole row share it)."""
    small_batches(docs.sparkSession)
    id_ = F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), F.xxhash64(id_, "text").alias("_k"), "text", *more)


def quoted(name: str) -> str:
    """A column name, whatever it has in it, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> None:
    """checkpoint() goes to the folder that the cluster names. On one machine, where none is named, to a folder of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: later steps neither repeat the work nor need the old shuffle files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    h = (h ^ (h >> U64(30))) * M2
    h = (h ^ (h >> U64(27))) * M3
    return h ^ (h >> U64(31))


def powers(of: np.uint64, n: int) -> np.ndarray:
    """of ** 0 to n - 1, modulo 2**64."""
    return np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, of)]))


def hashes_of(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a piece, which has one space between words: each word's bytes weigh by their place in the word."""
    space = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], space + 1]), np.concatenate([space, [len(data)]])
    up, down = (UP, DOWN) if len(data) < WORDS_PIECE else (powers(M1, len(data) + 1), powers(M1_INVERSE, len(data) + 1))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(BYTES[data] * up[: len(data)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * M3)


BYTES = mix(np.arange(1, 257, dtype=U64) * M2)
UP, DOWN = powers(M1, WORDS_PIECE), powers(M1_INVERSE, WORDS_PIECE)


class WordHashes:
    """64-bit hashes of words (bytes without spaces)."""

    def of(self, words: list[bytes]) -> np.ndarray:
        data, found, at = b" ".join(words), [np.empty(0, U64)], 0
        while at < len(data):
            end = len(data)
            if at + WORDS_PIECE < end:
                end = data.rfind(b" ", at, at + WORDS_PIECE)
                end = data.find(b" ", at + WORDS_PIECE) if end < 0 else end
                end = len(data) if end < 0 else end
            found.append(hashes_of(np.frombuffer(data, np.uint8, end - at, at)))
            at = end + 1
        return found[1] if len(found) == 2 else np.concatenate(found)


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries; order counts. Empty if there are fewer than n."""
    if len(w) < n:
        return np.empty(0, U64)
    h = w[: len(w) - n + 1].copy()
    for i in range(1, n):
        h *= M1
        h += w[i : len(w) - n + 1 + i]
        h ^= h >> U64(29)
    return mix(h)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def frugal() -> None:
    """Large arrays go back to the system when they are freed; else a worker that serves many tasks keeps its highest need. Cycles are looked
    for between tasks only: batches hold many small objects, and none in cycles."""
    gc.disable()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed


def release() -> None:
    """Give freed memory back to the system, between batches and tasks of one Python worker."""
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 512, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    frugal()
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(x.nbytes if isinstance(x, np.ndarray) else len(x) for x in row if isinstance(x, (bytes, str, np.ndarray)))
        if len(held) >= most or n >= most_bytes:
            yield written(held, schema)
            held, n = [], 0
    if held:
        yield written(held, schema)
    del held
    release()


def tasks_for(docs: DataFrame) -> int:
    """Tasks of an exchange of what is made from the texts of ``docs``: the session's shuffle partitions, or more for more text."""
    n = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_BYTES))


def dealt(df: DataFrame, to: str | Column, tasks: int) -> DataFrame:
    """``df`` over ``tasks`` partitions by ``to`` (long) modulo their number: numbers in a row go to different tasks."""
    return df.repartitionById(tasks, F.pmod(F.col(to) if isinstance(to, str) else to, F.lit(tasks)).cast("int"))


def packed(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x))


def unpacked(data: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def bloom(keys: DataFrame, key: Column) -> tuple[DataFrame, int]:
    """One-hash Bloom filter over ``key`` (long): rows (_w, _bits) of BLOOM_ROW words each, BLOOM_WORDS words at most, and its width in bits.

    Its size follows the count of keys up to that bound; beyond it more rows pass, none is lost.
    """
    n = keys.count()
    words = 64
    while words < BLOOM_WORDS and words * 64 < 24 * n:
        words *= 2
    bit = F.pmod(key, F.lit(words * 64))
    each = keys.select((bit / 64).cast("int").alias("_i"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("_b")).groupBy("_i").agg(F.bit_or("_b").alias("_b"))
    row = each.groupBy((F.col("_i") / BLOOM_ROW).cast("int").alias("_w")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("_i", F.lit(BLOOM_ROW)).alias("k"), F.col("_b").alias("v")))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(min(words, BLOOM_ROW) - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("long")))
    return row.select("_w", dense.alias("_bits")), words * 64


def bloom_mark(rows: DataFrame, key: Column, filter_: tuple[DataFrame, int], name: str) -> DataFrame:
    """Adds a boolean: false means that the key is surely none of the filter's. The filter is broadcast: its rows are bounded."""
    words, bits = filter_
    bit = F.pmod(key, F.lit(bits))
    word = F.get("_bits", F.pmod((bit / 64).cast("int"), F.lit(BLOOM_ROW)))
    return (
        rows.withColumn("_w", (bit / (64 * BLOOM_ROW)).cast("int"))
        .join(F.broadcast(words), "_w", "left")
        .withColumn(name, F.coalesce(F.call_function("shiftrightunsigned", word, F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False)))
        .drop("_w", "_bits")
    )
