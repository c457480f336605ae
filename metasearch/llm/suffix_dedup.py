"""Removal of repeated byte strings by sorted suffixes: front-coded runs, merged by loser trees that know common prefixes.

Every string of ``length`` bytes has an anchor: the smallest 32-byte gram in it. Equal strings have equal anchors at equal offsets, so two strings are equal if
the texts agree far enough to the left and to the right of their anchors. Anchors that occur once are left out (shared.py). For the
others each map task cuts the suffix that starts at the anchor (``length`` bytes at most) and the bytes to its left, collapses equal
ones to the first place, sorts the suffixes and front-codes them into runs, one a key range. A reducer merges
the runs of a range: its loser tree keeps for each run the common prefix with the last string put out, compares these numbers first, and reads bytes
only beyond a prefix known to be common. The merge gives the suffixes in order with their common prefixes; for each offset of the anchor
these (and the same for the left sides) number the equal strings, and all but the first place of each are removed.

An anchor with thousands of occurrences would send them all to one range. Its strings are sent one by one instead, each by its own
hash, after equal ones have collapsed; all tasks know the same anchors as hot.

Strings are judged on the input. "Earlier" goes by doc_id, then by start.

Defined results: a null text has no bytes; null ids come before all others; rows with equal ids are one document; texts shorter than
``length`` lose nothing; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasearch.llm import shared
from metasearch.llm.base import M1, U64, cut, dealt, in_batches, keyed, mix, packed, release, rows_of, tasks_for, unpacked, utf8

LENGTH, GRAM = 100, 32
#: Bytes of segments that one map task holds before it sorts them into runs.
HELD = 12 << 20
#: Starts of strings looked at a time, so that a very long text needs little memory.
PIECE = 1 << 20
NO_ID = -(1 << 63)
#: Bytes that one comparison takes up at a time.
STEP = 16


def gram_keys(data: np.ndarray) -> np.ndarray:
    """Hash of each GRAM bytes in a row, from runs of half the length."""
    h = data.astype(U64) + U64(1)
    for step in (1, 2, 4, 8, 16):
        h = h[:-step] * M1 + h[step:]
        h ^= h >> U64(29)
    return mix(h)


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first start, last start) of the strings of ``length`` bytes that share an anchor."""
    array, found = np.frombuffer(data, np.uint8), []
    for at in range(0, len(array) - length + 1, PIECE):
        g = gram_keys(array[at : at + PIECE + length - 1])
        place, first, last = shared.minimizers(g, length - GRAM + 1)
        # the smallest of many hashes: hashed again, keys lie evenly over the ranges
        found.append((mix(g[place]), place + at, first + at, last + at))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(U64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def common(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row of bytes with the row before (0 for the first)."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), rows.shape[1])])


def matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def front_coded(entries: list[tuple], length: int) -> bytes:
    """A run: (suffix, left side reversed, doc, _k, place) sorted by suffix; prefixes shared with the suffix before are left out."""
    entries.sort(key=lambda e: e[0])
    rows = matrix([e[0] for e in entries], length)
    lcp = common(rows)
    lcp[0] = 0
    tails = rows[np.arange(length) >= lcp[:, None]].tobytes()
    numbers = np.array([(len(e[0]), len(e[1]), NO_ID if e[2] is None else e[2], e[3], e[4]) for e in entries], np.int64)
    return packed((lcp.astype(np.uint8), tails, b"".join(e[1] for e in entries), numbers, [e[2] is None for e in entries]))


def differ_at(x: bytes, y: bytes, at: int) -> int:
    """The first place from ``at`` on where x and y differ, or their length. Reads STEP bytes of each at a time, and none before ``at``."""
    while at < len(x):
        a, b = x[at : at + STEP], y[at : at + STEP]
        if a != b:
            return at + len(a) - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8
        at += STEP
    return len(x)


def merged(runs: list[tuple[np.ndarray, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, lcp, read): the entries of all runs (numbered run after run) by suffix, each with its common prefix with the one before; and the
    bytes of a suffix that comparisons read.

    A run is (common prefixes, tails); suffixes have ``length`` bytes. A contender's number is its common prefix with the last suffix put out. Of
    two, the one with the larger number comes first, without a byte read; equal numbers are followed by a comparison from there on.
    """
    values, prefixes, base = [], [], [0]
    for lcp, tails in runs:
        own, at, last = [], 0, b""
        for h in lcp.tolist():
            last = last[:h] + tails[at : at + length - h]
            at += length - h
            own.append(last)
        values.append(own)
        prefixes.append(lcp.tolist())
        base.append(base[-1] + len(own))
    k, read = 1 << max(0, (len(runs) - 1).bit_length()), 0
    now: list[bytes | None] = [own[0] for own in values] + [None] * (k - len(runs))
    next_ = [1] * len(runs)
    known = [0] * len(runs) + [-1] * (k - len(runs))  # -1: a run at its end loses to all others
    tree = [0] * k

    def loser(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two with the same number; the loser's becomes its common prefix with the winner."""
        nonlocal read
        h = known[a]
        if h < 0:
            return a, b
        x, y = now[a], now[b]
        at = differ_at(x, y, h)
        read += min(length, at + 1) - h
        if at < length and y[at] < x[at]:
            a, b = b, a
        known[b] = at
        return a, b

    # first round: the losers of a tournament
    winners, level = list(range(k)), k
    while level > 1:
        up = []
        for i in range(0, level, 2):
            a, b = winners[i], winners[i + 1]
            if known[a] == known[b]:
                a, b = loser(a, b)
            elif known[a] < known[b]:
                a, b = b, a
            tree[(level + i) // 2] = b
            up.append(a)
        winners, level = up, level // 2
    best = winners[0]
    order, lcp = [], []
    total = base[-1]
    while len(order) < total:
        i = next_[best]
        order.append(base[best] + i - 1)
        lcp.append(known[best])
        own = values[best]
        if i < len(own):
            now[best], known[best], next_[best] = own[i], prefixes[best][i], i + 1
        else:
            now[best], known[best] = None, -1
        node = (k + best) // 2
        while node:
            other = tree[node]
            if known[best] == known[other]:
                best, tree[node] = loser(best, other)
            elif known[best] < known[other]:
                tree[node], best = best, other
            node //= 2
    return np.array(order, np.int64), np.array(lcp, np.int64), read


def repeated(runs: list[bytes], length: int) -> dict[tuple, list]:
    """(doc, _k) -> spans of the strings in the runs that occur earlier."""
    coded = [unpacked(r) for r in runs]
    order, lcp, _ = merged([(c[0], c[1]) for c in coded], length)
    numbers, null = np.concatenate([c[3] for c in coded]), [x for c in coded for x in c[4]]
    alike = lcp >= GRAM
    several = alike | np.concatenate([alike[1:], [False]])
    order, lcp = order[several], lcp[several]
    if not len(order):
        return {}
    right, left, doc, k, place = numbers[order].T
    starts = np.concatenate([[0], np.cumsum(numbers[:, 1])])
    sides = b"".join(c[2] for c in coded)
    width = max(1, length - GRAM)
    rows = matrix([sides[starts[i] : starts[i + 1]] for i in order.tolist()], width)
    by_left = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    left_lcp = common(rows[by_left])
    n = len(order)
    by_place = np.lexsort((place, doc))
    least, most = np.full(n, length), np.full(n, -1)
    left_class = np.empty(n, np.int64)
    for o in range(length - GRAM + 1):
        on = by_place[(right[by_place] >= length - o) & (left[by_place] >= o)]
        if len(on) < 2:
            continue
        left_class[by_left] = np.cumsum(left_lcp < o)
        key = np.cumsum(lcp < length - o)[on] * (n + 1) + left_class[on]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        head = on[first][which]
        late = on[(doc[head] != doc[on]) | (place[head] != place[on])]
        least[late] = np.minimum(least[late], o)
        most[late] = o
    removed = defaultdict(list)
    # strings of one anchor all hold it: what they cover together is one span
    for i in np.flatnonzero(most >= 0).tolist():
        at = int(place[i])
        removed[None if null[order[i]] else int(doc[i]), int(k[i])].append((at - int(most[i]), at - int(least[i]) + length))
    return removed


def spans_of(marked: DataFrame, length: int, tasks: int) -> DataFrame:
    """doc_id, _k, spans of removed bytes (joined, of one task's view) for rows with text and marks."""
    bits = shared.ranges(tasks).bit_length() - 1
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("_k", pa.int64()), ("data", pa.binary())])

    def keep(held: dict, name: tuple, doc: int | None, first: int, k: int, size: int, hot: bool, removed: dict) -> int:
        """Keep the first place of a string; the other is removed. The bytes that are new."""
        own = held.get(name)
        if own is None:
            held[name] = doc, first, k, hot
            return size
        here, there = (NO_ID if doc is None else doc, first), (NO_ID if own[0] is None else own[0], own[1])
        if here < there:
            held[name] = doc, first, k, hot
            removed[own[0], own[2]].append((own[1], own[1] + size))
        elif there < here:
            removed[doc, k].append((first, first + size))
        return 0

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: dict, removed: dict) -> Iterator[tuple]:
            by_shard, strings = defaultdict(list), {}
            for (anchor, offset, segment), (doc, first, k, hot) in held.items():
                if hot:  # each string by itself: a hot anchor's strings go to many shards, by all of their bytes
                    for i in range(len(segment) - length + 1):
                        string = segment[i : i + length]
                        keep(strings, (xxhash.xxh64_intdigest(string), 0, string), doc, first + i, k, length, True, removed)
                else:
                    by_shard[anchor >> (64 - bits)].append((segment[offset:], segment[:offset][::-1], doc, k, first + offset))
            held.clear()
            for (anchor, _, string), (doc, first, k, _) in strings.items():
                by_shard[anchor >> (64 - bits)].append((string, b"", doc, k, first))
            strings.clear()
            while by_shard:
                s, entries = by_shard.popitem()
                yield s, None, None, front_coded(entries, length)
            for doc, k, spans in shared.span_rows(removed):
                yield None, doc, k, spans

        def rows() -> Iterator[tuple]:
            held, removed, n = {}, defaultdict(list), 0
            for doc, k, text, n_keys, marks, hot in rows_of(batches, "doc_id", "_k", "text", "n_keys", "marks", "hot"):
                data = utf8(text)
                key, place, first, last = anchors(data, length)
                at, hot = np.flatnonzero(shared.bits_of(marks, n_keys)), shared.bits_of(hot, n_keys)
                for a, p, f, e, h in zip(key[at].tolist(), place[at].tolist(), first[at].tolist(), (last[at] + length).tolist(), hot[at].tolist(), strict=True):
                    n += keep(held, (a, p - f, data[f:e]), doc, f, k, e - f, h, removed) * (8 if h else 1)
                if n >= HELD:
                    yield from flush(held, removed)
                    release()
                    removed, n = defaultdict(list), 0
            yield from flush(held, removed)

        yield from in_batches(rows(), schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            shards: dict[int, list[bytes]] = defaultdict(list)
            for s, doc, k, data in rows_of(batches, "shard", "doc_id", "_k", "data"):
                if s is None:
                    yield doc, k, data
                else:
                    shards[s].append(data)
            while shards:
                yield from shared.span_rows(repeated(shards.popitem()[1], length))

        yield from in_batches(rows(), shared.SPANS)

    # in a fixed order: a task that is run again after an executor's loss makes the same batches
    marked = marked.select("doc_id", "_k", "text", "n_keys", "marks", "hot").sortWithinPartitions("doc_id", "_k")
    sent = marked.mapInArrow(gather, "shard bigint, doc_id bigint, _k bigint, data binary")
    return dealt(sent, F.coalesce("shard", F.col("_k")), tasks).mapInArrow(merge, shared.SPANS_DDL)


def with_removed(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` (with doc_id, _k, text) and _spans: parts of the byte spans to remove, or null."""

    def describe():  # noqa: ANN202
        return lambda text: (anchors(utf8(text), length)[0], b"")

    tasks = tasks_for(docs)
    marks = cut(shared.shared_keys(docs, describe, tasks=tasks).drop("extra").dropDuplicates(["doc_id", "_k"]))
    maybe, _ = shared.split_by(docs.select("doc_id", "_k", "text"), marks)
    return shared.with_spans(docs, spans_of(shared.with_rows(maybe, marks), length, tasks))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row. ``length``: 33 to 255 bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc, text, parts in rows_of(batches, "doc_id", "text", "_spans"):
                data, spans = utf8(text), shared.read_spans(parts)
                edges = [0, *spans.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                yield doc, len(data), len(data) - len(kept), len(spans), shared.sha(kept)

        yield from in_batches(rows(), schema, 4096)

    return with_removed(keyed(docs), length).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
