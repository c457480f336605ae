"""Which keys of a document also occur elsewhere, without a row a key; and removal of word or byte spans.

Every document has an array of 64-bit keys. Map tasks gather documents into batches, tell keys that repeat within the batch, and pack
the batch's distinct keys by key range: one row a (batch, range), so that a key which millions of documents share is sent
once a batch. Reducers see for each range which keys come from several batches and answer each batch with the places of those. The
keys themselves are never joined back: a document learns a bit for each of its keys, in order.

Batches follow the order of the input's partitions. So that a task that is run again makes the same ones, the input should be a stored table or
a checkpoint, not the far side of an exchange.

Keys with HOT or more occurrences are told apart by a second bit, the same for every document: callers spread their groups more finely. The number of
tasks and ranges follows the bytes of text, so what meets in one task stays the same while the data grows.

Keys are compared by a fingerprint of 40 bits or more: a marked key may rarely be single, a shared one is never missed. Callers verify.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasearch.llm.base import U64, bloom, bloom_mark, cut, dealt, in_batches, packed, rows_of, tasks_for, unpacked

#: Keys, and documents, of a batch at most (a document is never split).
BATCH_KEYS, BATCH_DOCS = 1 << 20, 1 << 15
#: Occurrences from which on a key counts as hot.
HOT = 10_000
PACK = pa.schema([("route", pa.int64()), ("batch", pa.int64()), ("meta", pa.bool_()), ("data", pa.binary())])
PACK_DDL = "route bigint, batch bigint, meta boolean, data binary"
MARKS = pa.schema([("doc_id", pa.int64()), ("_k", pa.int64()), ("extra", pa.binary()), ("n_keys", pa.int64()), ("n_shared", pa.int64()), ("marks", pa.binary()), ("hot", pa.binary())])


def ranges(tasks: int) -> int:
    """Key ranges for so many tasks: a power of two. What lies in 4 to 8 of them meets in one task."""
    return 1 << min(17, max(8, (4 * tasks - 1).bit_length()))


def shared_keys(docs: DataFrame, describe: Callable[[], Callable[[str | None], tuple[np.ndarray, bytes]]], only_shared: bool = True, tasks: int | None = None) -> DataFrame:
    """doc_id, _k, extra, n_keys, n_shared, marks, hot (bits, least first; hot is null if none is) for rows of (doc_id, _k, text).

    Keys should lie evenly over 64 bits. ``describe()`` is called once a task and gives the function from a text to its keys and some bytes to keep. A key counts as shared
    if it occurs twice or more among all documents, also within one. ``only_shared`` leaves out documents without a shared key.
    """
    tasks = tasks or tasks_for(docs)
    n_ranges = ranges(tasks)
    bits = n_ranges.bit_length() - 1
    # a pack holds 32 keys of a range or more
    batch_keys = max(BATCH_KEYS, 32 * n_ranges)

    def flush(batch: int, held: list[tuple]) -> Iterator[tuple]:
        sizes = np.array([len(k) for _, _, k, _ in held], np.int64)
        keys = np.concatenate([k for _, _, k, _ in held])
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        count = np.diff(np.concatenate([starts, [len(s)]]))
        marks = np.zeros(len(keys), bool)
        marks[order] = np.repeat(count > 1, count)
        place, often = order[starts].astype(np.uint32), np.minimum(count, 0xFFFF).astype(np.uint16)
        # further places of a key that repeats in the batch, and its first one
        later = np.flatnonzero(~first)
        repeats = np.stack([order[later], np.repeat(order[starts], count)[later]]).astype(np.uint32)
        u = s[starts]
        prints = (u >> U64(32 - bits)).astype(np.uint32) if bits <= 32 else u.astype(np.uint32)
        edges = np.searchsorted(u, np.arange(n_ranges, dtype=U64) << U64(64 - bits))
        for r, (a, b) in enumerate(zip(edges, [*edges[1:], len(u)], strict=True)):
            if a < b:
                yield r, batch, False, prints[a:b].tobytes() + place[a:b].tobytes() + often[a:b].tobytes()
        meta = [d for d, *_ in held], [k for _, k, *_ in held], [e for *_, e in held], sizes, np.packbits(marks, bitorder="little"), repeats if only_shared else None
        yield n_ranges + batch, batch, True, packed(meta)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            describe_ = describe()
            batch, held, n = TaskContext.get().partitionId() << 24, [], 0
            for doc, k, text in rows_of(batches, "doc_id", "_k", "text"):
                keys, extra = describe_(text)
                held.append((doc, k, keys, extra))
                n += len(keys)
                if n >= batch_keys or len(held) >= BATCH_DOCS:
                    yield from flush(batch, held)
                    batch, held, n = batch + 1, [], 0
            if held:
                yield from flush(batch, held)

        yield from in_batches(rows(), PACK)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
            for route, batch, meta, data in rows_of(batches, "route", "batch", "meta", "data"):
                if meta:
                    yield route, batch, meta, data
                else:
                    held[route].append((batch, data))
            found: dict[int, list[np.ndarray]] = defaultdict(list)
            while held:
                _, packs = held.popitem()
                sizes = np.array([len(d) // 10 for _, d in packs])
                prints, place, often = (np.concatenate([np.frombuffer(d, kind, n, at * n) for (_, d), n in zip(packs, sizes, strict=True)]) for kind, at in ((np.uint32, 0), (np.uint32, 4), (np.uint16, 8)))
                order = np.argsort(prints, kind="stable")
                first = np.concatenate([[True], prints[order][1:] != prints[order][:-1]])
                starts = np.flatnonzero(first)
                rows = np.diff(np.concatenate([starts, [len(order)]]))
                hot = np.add.reduceat(often[order].astype(np.int64), starts) >= HOT
                told, is_hot = np.empty(len(prints), bool), np.empty(len(prints), bool)
                # a key that repeats in its one batch only is known there
                told[order], is_hot[order] = np.repeat((rows > 1) | hot, rows), np.repeat(hot, rows)
                answer = place.astype(np.int64) | is_hot.astype(np.int64) << 32
                for (batch, _), part, own in zip(packs, np.split(answer, np.cumsum(sizes)[:-1]), np.split(told, np.cumsum(sizes)[:-1]), strict=True):
                    if own.any():
                        found[batch].append(part[own])
            for batch, parts in found.items():
                yield batch, batch, False, np.concatenate(parts).tobytes()

        yield from in_batches(rows(), PACK)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            metas, places = {}, defaultdict(list)
            for batch, meta, data in rows_of(batches, "batch", "meta", "data"):
                if meta:
                    metas[batch] = data
                else:
                    places[batch].append(np.frombuffer(data, np.int64))
            for batch, data in metas.items():
                docs, ks, extras, sizes, marks, repeats = unpacked(data)
                marks = np.unpackbits(marks, count=int(sizes.sum()), bitorder="little").astype(bool)
                hot = np.zeros(len(marks), bool)
                for p in places.pop(batch, ()):
                    marks[p & 0xFFFFFFFF] = True
                    hot[p[p >> 32 > 0] & 0xFFFFFFFF] = True
                if repeats is not None:
                    hot[repeats[0]] = hot[repeats[1]]
                ends = np.cumsum(sizes)[:-1]
                for doc, k, extra, own, own_hot in zip(docs, ks, extras, np.split(marks, ends), np.split(hot, ends), strict=True):
                    n = int(own.sum())
                    if not only_shared:
                        yield doc, k, extra, len(own), n, None, None
                    elif n:
                        yield doc, k, extra, len(own), n, np.packbits(own, bitorder="little").tobytes(), np.packbits(own_hot, bitorder="little").tobytes() if own_hot.any() else None

        yield from in_batches(rows(), MARKS)

    packs = docs.select("doc_id", "_k", "text").mapInArrow(pack, PACK_DDL)
    met = dealt(packs, "route", tasks).mapInArrow(meet, PACK_DDL)
    # a batch is its map task's number, times 2**24, and its number there
    return dealt(met, F.shiftright("batch", 24) + F.col("batch").bitwiseAND(F.lit((1 << 24) - 1)), tasks).mapInArrow(answer, "doc_id bigint, _k bigint, extra binary, n_keys bigint, n_shared bigint, marks binary, hot binary")


def bits_of(marks: bytes | None, n: int) -> np.ndarray:
    if marks is None:
        return np.zeros(n, bool)
    return np.unpackbits(np.frombuffer(marks, np.uint8), count=n, bitorder="little").astype(bool)


def minimizers(keys: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of each minimizer: the place of the smallest key (the first of equals) in each run of
    ``window`` keys; neighbouring runs with one place are one entry. Equal runs choose alike, wherever they stand."""
    n = len(keys) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    low = U64((1 << 26) - 1)
    if len(keys) > 1 << 26:
        raise ValueError("more than 2**26 keys at a time")
    padded = np.full(-(-len(keys) // window) * window, U64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = (keys & ~low) | np.arange(len(keys), dtype=U64)
    blocks = padded.reshape(-1, window)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(before[:n], after[window - 1 : window - 1 + n]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, np.concatenate([first[1:] - 1, [n - 1]])


def split_by(docs: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among ``marked``, rows that surely aren't), by a bounded Bloom filter on _k."""
    both = bloom_mark(docs, F.col("_k"), bloom(marked, F.col("_k")), "_maybe")
    return both.filter("_maybe").drop("_maybe"), both.filter("not _maybe").drop("_maybe")


def with_rows(docs: DataFrame, more: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` with the columns of ``more``, which has one row a (doc_id, _k)."""
    more = more.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_k2"), *[c for c in more.columns if c not in ("doc_id", "_k")])
    return docs.join(more, (docs["_k"] == more["_k2"]) & docs["doc_id"].eqNullSafe(more["_d"]), how).drop("_d", "_k2")


def joined(spans: np.ndarray) -> np.ndarray:
    """Sorted spans [n, 2] without overlap or touch."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    return np.stack([spans[first, 0], ends[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(ends) - 1]])]], axis=1)


SPANS = pa.schema([("doc_id", pa.int64()), ("_k", pa.int64()), ("spans", pa.binary())])
SPANS_DDL = "doc_id bigint, _k bigint, spans binary"


def span_rows(spans: dict[tuple, list]) -> Iterator[tuple]:
    """A row of joined spans for each document."""
    for (doc, k), own in spans.items():
        if own:
            yield doc, k, joined(np.concatenate([np.asarray(x, np.int64).reshape(-1, 2) for x in own])).tobytes()


def read_spans(parts: list[bytes] | None) -> np.ndarray:
    return joined(np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in parts])) if parts else np.empty((0, 2), np.int64)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All ``docs`` with _spans, array<binary> or null: only those that may have span rows are joined with them."""
    own = cut(spans.groupBy("doc_id", "_k").agg(F.collect_list("spans").alias("_spans")))
    maybe, rest = split_by(docs, own)
    return with_rows(maybe, own, "left").unionByName(rest.withColumn("_spans", F.lit(None).cast("array<binary>")))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
