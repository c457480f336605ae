"""Benchmark decontamination: SimHash windows of an item's size, multi-index Hamming blocks, exact verification.

Words are runs of digits, letters a-z (lower-cased) and characters beyond ASCII. An item of L words is looked for in windows of L
words (a shorter document is one window). Items and windows are bags of 5-word shingles; each occurrence of a shingle is an element of its own, so the weighted
Jaccard similarity is that of the sets of elements. A fingerprint has 256 bits, each the majority of the elements' votes; the share of bits in which two
differ follows their similarity.

The items' fingerprints lie in tables of 16 blocks of 16 bits. Two fingerprints within RADIUS = 47 bits differ in 2 bits or fewer in one block at least: items
are listed under their block and its 16 neighbours, a window asks for its block and its neighbours, so the tables return every item within the
radius, and 3 % of unrelated ones. Candidates within the radius are verified by their exact similarity. Only windows with enough shingles
of items of their size are fingerprinted: no other can reach the threshold.

At a similarity of 0.8 or more a window lies within the radius almost always, but not by law. ``complete`` (the default) also counts, in the same windows, the elements
shared with each item for all starts at once, so that windows beyond the radius (of repeated words, mostly) are reported as well.

Items are broadcast in blocks of at most ITEM_WORDS words (or one item); the documents are read once, however many blocks there are.

Defined results: null or wordless texts and items match nothing; items of fewer than 5 words are one shingle; equal items each report; a null item id is 0;
of equally similar windows the first is reported; repeated rows report alike; empty tables give no rows; other columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasearch.llm.base import M1, U64, WordHashes, gram_hashes, in_batches, mix, release, rows_of, small_batches, utf8

#: Words of all items in one broadcast block.
ITEM_WORDS = 250_000
SHINGLE = 5
BITS, BLOCK, NEAR = 256, 16, 2
BLOCKS = BITS // BLOCK
#: Hamming distance within which the tables return every fingerprint: further apart, all blocks may differ in more than NEAR bits.
RADIUS = BLOCKS * (NEAR + 1) - 1
SIMILARITY = 0.8
#: Bytes that aren't part of a word become spaces; A-Z become lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TABLE = 22
#: Elements whose votes are counted at a time, and bytes of text that meet a block of items before the next is loaded.
VOTES, PART = 1 << 16, 32 << 20
#: A block's value and those that differ in one bit.
AROUND = np.array([0, *(1 << i for i in range(BLOCK))], np.uint16)

#: One hash of an element for each 64 bits of a fingerprint.
LANES = np.arange(1, BITS // 32, 2, dtype=U64) * M1


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


def shingles(w: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the n-word shingles; the whole sequence if it is shorter."""
    return gram_hashes(w, min(n, len(w))) if len(w) else np.empty(0, U64)


def elements(h: np.ndarray) -> np.ndarray:
    """The sets of elements of bags of shingles, one a row: the k-th occurrence of a shingle differs from its first."""
    s, at = np.sort(h, axis=1), np.arange(h.shape[1])
    first = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
    return mix(s + (at - np.maximum.accumulate(np.where(first, at, 0), axis=1)).astype(U64) * M1)


def fingerprints(e: np.ndarray) -> np.ndarray:
    """[rows, BLOCKS] of 16 bits: each bit as most of the row's elements vote."""
    found = [np.empty((0, BLOCKS), np.uint16)]
    step = max(1, VOTES // max(1, e.shape[1]))
    for at in range(0, len(e), step):
        part = e[at : at + step]
        lanes = mix(part[:, :, None] ^ LANES)
        votes = np.unpackbits(lanes.view(np.uint8).reshape(*part.shape, BITS // 8), axis=2).sum(1, dtype=np.int32)
        found.append(np.packbits(2 * votes > e.shape[1], axis=1).view(np.uint16))
    return np.concatenate(found)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the rows of two arrays of fingerprints differ."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    inter = sum(min(n, y[k]) for k, n in x.items() if k in y)
    union = len(a) + len(b) - inter
    return inter / union if union else 0.0


class Tables:
    """The fingerprints of items of one length: for each block the items by its value and that value's neighbours, sorted."""

    def __init__(self, items: list[int], prints: np.ndarray) -> None:
        self.items, self.prints = np.array(items), prints
        own = np.repeat(np.arange(len(items), dtype=np.int32), len(AROUND))
        self.blocks = []
        for b in range(BLOCKS):
            keys = (prints[:, b, None] ^ AROUND).ravel()
            order = np.argsort(keys, kind="stable")
            self.blocks.append((keys[order], own[order]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of all that share a block but for NEAR bits, each pair once."""
        found, n = [np.empty(0, np.int64)], len(self.items)
        for b, (keys, own) in enumerate(self.blocks):
            ask = (prints[:, b, None] ^ AROUND).ravel()
            lo, hi = np.searchsorted(keys, ask, "left"), np.searchsorted(keys, ask, "right")
            count = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            found.append(np.repeat(np.arange(len(ask)) // len(AROUND), count) * n + own[at])
        pairs = np.unique(np.concatenate(found))
        return pairs // n, pairs % n

    def within(self, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within ``radius``, which is RADIUS at most."""
        window, place = self.candidates(prints)
        near = distance(prints[window], self.prints[place]) <= radius
        return window[near], self.items[place[near]]


class Items:
    """Fingerprint tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        memo = WordHashes()
        self.id, self.length, self.shingles, self.elements = [], [], [], []
        for item, text in items:
            w = memo.of(words_of(text))
            if len(w):
                self.id.append(item)
                self.length.append(len(w))
                self.shingles.append(shingles(w))
                self.elements.append(np.sort(elements(self.shingles[-1][None])[0]))
        # windows have an item's size, so each length has tables of its own
        by_length = defaultdict(list)
        for i, n in enumerate(self.length):
            by_length[n].append(i)
        self.tables = {n: Tables(own, fingerprints(np.stack([self.elements[i] for i in own]))) for n, own in by_length.items()}
        # by length of the items, sorted: shingle hash, item, how often it has it
        self.holders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, own in by_length.items():
            each = sorted((h, i, k) for i in own for h, k in Counter(self.shingles[i].tolist()).items())
            self.holders[n] = np.array([h for h, _, _ in each], U64), np.array([i for _, i, _ in each]), np.array([k for _, _, k in each])
        # seeds: shingle hash -> lengths of the items that have it, by shingle size
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size = defaultdict(set)
        for i, s in enumerate(self.shingles):
            by_size[min(SHINGLE, self.length[i])].update((h, self.length[i]) for h in s.tolist())
        for size, pairs in by_size.items():
            pairs = sorted(pairs)
            keys = np.array([h for h, _ in pairs], U64)
            near = np.zeros(1 << TABLE, bool)
            near[(keys >> U64(64 - TABLE)).astype(np.int64)] = True
            self.seeds[size] = np.packbits(near), keys, np.array([n for _, n in pairs])

    def opened(self) -> Items:
        """With the seeds' tables unpacked, for use."""
        self.seeds = {size: (np.unpackbits(near).astype(bool), keys, n) for size, (near, keys, n) in self.seeds.items()}
        return self

    def shared(self, h: np.ndarray, hits: np.ndarray, starts: np.ndarray, n: int, own: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, starts, similarities) of the windows that reach ``least``, for items of n words. ``h``: the text's shingles, ``hits``: places
        of those that items of n words have, ``own``: shingles of a window.

        The k-th last occurrence of a shingle counts in a window if the item has k of it: each place counts for a run of starts.
        """
        places: dict[int, list[int]] = defaultdict(list)
        for p, x in zip(hits.tolist(), h[hits].tolist(), strict=True):
            places[x].append(p)
        runs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        keys, items, often = self.holders[n]
        for x, at in places.items():
            at = np.array(at)
            a, b = np.searchsorted(keys, U64(x), "left"), np.searchsorted(keys, U64(x), "right")
            for i, k in zip(items[a:b].tolist(), often[a:b].tolist(), strict=True):
                earlier = np.concatenate([np.full(min(k, len(at)), -1), at[:-k]])
                runs[i].append((np.maximum(np.maximum(earlier, at - own) + 1, 0), at + 1))
        for i, pairs in runs.items():
            goal = own + len(self.shingles[i])
            need = least * goal / (1 + least) - 1e-6
            if sum(len(a) for a, _ in pairs) < need:
                continue
            first, last = np.sort(np.concatenate([a for a, _ in pairs])), np.sort(np.concatenate([b for _, b in pairs]))
            both = np.searchsorted(first, starts, "right") - np.searchsorted(last, starts, "right")
            sim = both / (goal - both)
            good = sim >= least
            if good.any():
                yield i, starts[good], sim[good]

    def matches(self, w: np.ndarray, least: float, radius: int = RADIUS, complete: bool = True) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words): the best window of each item that reaches ``least``."""
        # length of items -> how many hits begin and end to be in the window of each start
        windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, (near, keys, lengths) in self.seeds.items():
            if len(w) < size:
                continue
            h = gram_hashes(w, size)
            hits = np.flatnonzero(near[(h >> U64(64 - TABLE)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, h[hits], "left"), np.searchsorted(keys, h[hits], "right")
            hits, lo, hi = hits[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(hits):
                continue
            each = np.repeat(np.arange(len(hits)), hi - lo)
            found = lengths[np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            for n in np.unique(found).tolist():
                at = hits[np.unique(each[found == n])]
                change = np.zeros(len(w) + 2, np.int64)
                windows[n] = change, h, at
                np.add.at(change, np.maximum(0, at + size - n), 1)
                np.add.at(change, np.minimum(at, max(0, len(w) - n)) + 1, -1)
        best: dict[int, tuple[float, int, int]] = {}

        def better(i: int, sim: float, start: int, take: int) -> None:
            if i not in best or (sim, -start) > (best[i][0], -best[i][1]):
                best[i] = sim, start, take

        for n, (change, h, hits) in windows.items():
            take = min(n, len(w))
            size = min(SHINGLE, n)
            own = take - size + 1
            # an overlap of least / (1 + least) of both sizes is needed; all shingles that items of n words have bound it
            need = least * (own + n - size + 1) / (1 + least) - 1e-6
            starts = np.flatnonzero(np.cumsum(change)[: len(w) - take + 1] >= max(need, 1))
            # a few windows at a time, so that those of a long document are not all held at once
            step = max(1, 8 * VOTES // own)
            for at in range(0, len(starts), step):
                part = starts[at : at + step]
                sets = elements(h[part[:, None] + np.arange(own)])
                for k, i in zip(*(x.tolist() for x in self.tables[n].within(fingerprints(sets), radius)), strict=True):
                    both = len(np.intersect1d(sets[k], self.elements[i], assume_unique=True))
                    sim = both / (own + len(self.elements[i]) - both)
                    if sim >= least:
                        better(i, sim, int(part[k]), take)
            if complete and len(starts):
                for i, at, sim in self.shared(h, hits, starts, n, own, least):
                    top = int(np.argmax(sim))
                    better(i, float(sim[top]), int(at[top]), take)
        return [(self.id[i], *x) for i, x in sorted(best.items())]


def item_blocks(benchmark: DataFrame, item_words: int) -> list[Broadcast]:
    """Broadcast tables, each of items of ``item_words`` words at most, or of one item."""
    blocks, held, n = [], [], 0

    def close() -> None:
        if held:
            blocks.append(benchmark.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Items(sorted(held)))))
        held.clear()

    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").toLocalIterator():
        words = len(words_of(r["text"]))
        if n + words > item_words:
            close()
            n = 0
        held.append((r["item_id"] or 0, r["text"]))
        n += words
    close()
    return blocks


def found_in(blocks: list[Broadcast], rows: Iterator[tuple], least: float, radius: int, complete: bool) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each of ``rows`` (the last value is a text) with the matches of all blocks: a part of the rows meets one block after the other."""
    memo, table = WordHashes(), None

    def done(held: list[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
        nonlocal table
        found: list[list[tuple]] = [[] for _ in held]
        for block in blocks:
            own = table or pickle.loads(block.value).opened()
            table = own if len(blocks) == 1 else None
            for row, x in zip(held, found, strict=True):
                x += own.matches(memo.of(words_of(row[-1])), least, radius, complete)
        yield from zip(held, (sorted(x) for x in found), strict=True)

    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1] or "")
        if len(blocks) < 2 or n >= PART:
            yield from done(held)
            held, n = [], 0
    yield from done(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, item_words: int = ITEM_WORDS, complete: bool = True) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each (document, item) with ``least`` or more.

    ``least`` must be above 0, ``radius`` RADIUS at most.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
    small_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, item_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(((row[0], *m) for row, found in found_in(blocks, rows_of(batches, "doc_id", "text"), least, radius, complete) for m in found), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, item_words: int = ITEM_WORDS) -> DataFrame:
    """The documents that match no item, with all their columns."""
    small_batches(docs.sparkSession)
    blocks = item_blocks(benchmark, item_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                held.append(batch)
                yield from rows_of(iter([batch]), "text")

        keep: list[bool] = []
        for _, found in found_in(blocks, rows(), least, radius, True):
            keep.append(not found)
            while held and len(keep) >= held[0].num_rows:
                batch = held.pop(0)
                yield batch.filter(pa.array(keep[: batch.num_rows], pa.bool_()))
                del keep[: batch.num_rows]
        yield from (batch.filter(pa.array([], pa.bool_())) for batch in held)
        held.clear()
        release()

    return docs.mapInArrow(run, docs.schema) if blocks else docs
