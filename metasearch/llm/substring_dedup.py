"""Removal of word runs that an earlier document has: an FM-index a shard, backward search over a wavelet matrix.

A window is ``window`` consecutive words of one document (words lie between spaces, tabs and line ends). Each window has a minimizer,
its smallest 7-word gram; windows in a row that share one make a segment. Equal windows have equal minimizers, so segments whose
minimizer occurs nowhere else are left out, and the others meet in the shard of their minimizer. Equal segments collapse before and after the exchange.
A shard's distinct segments become a compressed FM-index: a BWT ordered by the first ``window`` words and more, in a wavelet
matrix whose runs of equal bits take no space, and no suffix order beside it. Segments are streamed against it: backward search gives each end's
match length up to the window and the interval of its occurrences; where the length is reached and the interval's smallest doc_id (one number a window
that occurs twice) is smaller, the window is removed.

A minimizer with thousands of occurrences would send them all to one shard. Its windows are sent one by one instead, each by its own
hash, after equal ones have collapsed; all tasks know the same minimizers as hot.

Removal is judged on the input: all windows are taken before any word goes.

Defined results: a null text has no words; null ids come before all others; rows with equal ids are one document, whose repeats don't remove
each other; texts shorter than a window lose nothing; an empty table gives no rows; extra columns pass through ``without_repeats`` unchanged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from metasearch.llm import shared
from metasearch.llm.base import U64, WordHashes, cut, dealt, gram_hashes, in_batches, keyed, mix, packed, quoted, release, rows_of, tasks_for, unpacked, utf8

WINDOW, GRAM = 13, 7
#: Bytes of segments that one map task holds before it sends them on.
HELD = 16 << 20
NO_ID = -(1 << 63)
#: Windows of a document looked at a time.
PIECE = 1 << 20
#: Windows searched at a time.
CHUNK = 1 << 17
#: Blocks of 64 bits whose counts are told from one number (32 at most); the bits before each place of a block.
GROUP = 32
MASKS = (U64(1) << np.arange(64, dtype=U64)) - U64(1)


class Bits:
    """A compressed bit array with counts: rank in constant time. Blocks of 64 bits that are all 0 or all 1 (a BWT has long runs) keep no bits. A block's head
    has its kind (0, mixed, 1), the kept blocks and the ones before it in its group of GROUP blocks; a group's, those before the group."""

    def __init__(self, bits: np.ndarray) -> None:
        n = -(-(len(bits) + 1) // (64 * GROUP)) * GROUP
        padded = np.zeros(64 * n, bool)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        count = np.bitwise_count(words).astype(np.int64)
        mixed = (count > 0) & (count < 64)
        self.words = np.append(words[mixed], U64(0))
        ones, slot = (np.concatenate([[0], np.cumsum(x)[:-1]]) for x in (count, mixed))
        self.groups = ones[::GROUP] << 32 | slot[::GROUP]
        within = [x - np.repeat(x[::GROUP], GROUP) for x in (ones, slot)]
        self.heads = (within[0] << 8 | within[1] << 2 | np.where(count == 64, 2, mixed)).astype(np.uint32)
        self.ones = int(count.sum())

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.groups.nbytes + self.heads.nbytes

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, bit = at >> 6, at & 63
        head, group = self.heads[block].astype(np.int64), self.groups[block // GROUP]
        kind = head & 3
        some = np.bitwise_count(self.words[(group & 0xFFFFFFFF) + (head >> 2 & 63)] & MASKS[bit])
        return (group >> 32) + (head >> 8) + np.where(kind == 1, some, (kind >> 1) * bit)


class FMIndex:
    """Counts of patterns up to ``depth`` symbols in a sequence of symbols (0 separates), and what the occurrences of patterns of ``length`` symbols
    have least in common: the smallest of their ``values``.

    The BWT lies in a wavelet matrix of compressed bits. The suffix order is dropped once the index is built; in its place stand a bit for
    each suffix that begins another pattern of ``length`` symbols, and one value a pattern that occurs twice or more.
    """

    def __init__(self, text: np.ndarray, depth: int, length: int = 0, values: np.ndarray | None = None) -> None:
        n, rank, sorted_ = len(text), np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        alike = None
        while sorted_ < depth:
            shifted = np.zeros(n, np.int64)
            shifted[: n - sorted_] = rank[sorted_:] + 1
            rank = np.unique(rank * (n + 2) + shifted, return_inverse=True)[1].astype(np.int64)
            sorted_ *= 2
        order = np.argsort(rank, kind="stable")
        self.size = n
        if values is not None:
            # suffixes in a row that agree in ``length`` symbols
            alike = np.zeros(n, bool)
            at, before = order[1:], order[:-1]
            same = np.arange(1, n)
            for i in range(length):
                ok = (at + i < n) & (before + i < n)
                ok[ok] = text[at[ok] + i] == text[before[ok] + i]
                same, at, before = same[ok], at[ok], before[ok]
            alike[same] = True
            starts = np.flatnonzero(~alike)
            several = np.diff(np.append(starts, n)) > 1
            self.begins, self.repeats = Bits(~alike), Bits(several)
            self.least = np.minimum.reduceat(values[order], starts)[several]
        bwt = text[order - 1]
        symbols = int(text.max()) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels = []
        row = bwt
        for shift in reversed(range(max(1, (symbols - 1).bit_length()))):
            bit = (row >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), n - int(bit.sum())))
            row = np.concatenate([row[~bit], row[bit]])
        self.base = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    @property
    def nbytes(self) -> int:
        """What the index keeps."""
        return sum(bits.nbytes for _, bits, _ in self.levels) + self.starts.nbytes + self.base.nbytes + sum(x.nbytes for x in (self.begins, self.repeats, self.least))

    def least_of(self, lo: np.ndarray) -> np.ndarray:
        """The least value of each pattern of ``length`` symbols that occurs twice or more, from where its interval begins."""
        return self.least[self.repeats.rank(self.begins.rank(lo))]

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern from those of the patterns."""
        start, both = self.starts[symbol] - self.base[symbol], self._walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return start + both[: len(lo)], start + both[len(lo) :]

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray, most: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, lo, hi) for each end in ``stream``: the longest match up to ``most`` symbols that ends there with ``least``
        occurrences or more, and its interval."""
        # one symbol's interval is known without a search
        last = stream[ends]
        lo, hi = self.starts[last], self.starts[last + 1]
        found = (last > 0) & (hi - lo >= least)
        lo, hi, length, going = np.where(found, lo, 0), np.where(found, hi, self.size), found.astype(np.int64), np.flatnonzero(found)
        for step in range(1, most):
            going = going[ends[going] >= step]
            symbol = stream[ends[going] - step]
            going, symbol = going[symbol > 0], symbol[symbol > 0]
            a, b = self.extend(symbol, lo[going], hi[going])
            found = b - a >= least
            going = going[found]
            lo[going], hi[going] = a[found], b[found]
            length[going] += 1
        return length, lo, hi


def anchors(w: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer hash, first window, last window) of a document's segments."""
    gram, found = min(GRAM, window), []
    for at in range(0, len(w) - window + 1, PIECE):
        g = gram_hashes(w[at : at + PIECE + window - 1], gram)
        place, first, last = shared.minimizers(g, window - gram + 1)
        # the smallest of many hashes: hashed again, keys lie evenly over the shards
        found.append((mix(g[place]), first + at, last + at))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(U64), none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def earlier_windows(segments: list[tuple[bytes, int]], window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(segment, first words of its windows that a segment with a smaller id has), for (words, id) of distinct segments."""
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(x, len(number) + 1) for x in s.split()] + [0]) for s, _ in segments]
    sizes = np.array([len(r) for r in rows])
    text, start = np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(rows)), sizes)
    ids = np.array([d for _, d in segments])
    index = FMIndex(text, window + 1, window, ids[owner])
    inside = np.arange(len(text)) - start[owner]
    ends = np.flatnonzero((inside >= window - 1) & (text > 0))
    hit = np.zeros(len(ends), bool)
    # the documents' segments are streamed against the index, some windows at a time
    for at in range(0, len(ends), CHUNK):
        part = ends[at : at + CHUNK]
        length, lo, _ = index.matching_statistics(text, part, window, 2)
        full = np.flatnonzero(length >= window)
        hit[at + full] = index.least_of(lo[full]) < ids[owner[part[full]]]
    ends = ends[hit]
    if not len(ends):
        return
    first = np.flatnonzero(np.concatenate([[True], owner[ends][1:] != owner[ends][:-1]]))
    for s, own in zip(owner[ends[first]].tolist(), np.split(inside[ends] - window + 1, first[1:]), strict=True):
        yield s, own


def spans_of(marked: DataFrame, window: int, tasks: int) -> DataFrame:
    """doc_id, _k, spans of removed words (joined, of one task's view) for rows with text and marks."""
    bits = shared.ranges(tasks).bit_length() - 1
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("_k", pa.int64()), ("spans", pa.binary())])
    ddl = "shard bigint, doc_id bigint, _k bigint, spans binary"

    def collapse(held: dict, key: tuple, doc: int, places: list[tuple], removed: dict[tuple, list]) -> None:
        """Keep the places of the smallest id; those of larger ids are removed whole. A place: (doc_id, _k, first word, end)."""
        own = held.get(key)
        if own is None:
            held[key] = [doc, places]
            return
        if doc == own[0]:
            own[1] += places
            return
        late = places
        if doc < own[0]:
            late, own[0], own[1] = own[1], doc, places
        for d, k, a, b in late:
            removed[d, k].append((a, b))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: dict, removed: dict) -> Iterator[tuple]:
            by_shard, windows = defaultdict(list), {}
            for (anchor, words, hot), (doc, places) in held.items():
                if hot:  # each window by itself: a hot minimizer's windows go to many shards, by all of their words
                    words = words.split()
                    for i in range(len(words) - window + 1):
                        part = b" ".join(words[i : i + window])
                        collapse(windows, (xxhash.xxh64_intdigest(part), part), doc, [(d, k, a + i, a + i + window) for d, k, a, _ in places], removed)
                else:
                    by_shard[anchor >> (64 - bits)].append((anchor, words, doc, places))
            for (anchor, words), own in windows.items():
                by_shard[anchor >> (64 - bits)].append((anchor, words, *own))
            for s, rows in by_shard.items():
                yield s, None, None, packed(rows)
            for doc, k, spans in shared.span_rows(removed):
                yield None, doc, k, spans

        def rows() -> Iterator[tuple]:
            memo, held, removed, n = WordHashes(), {}, defaultdict(list), 0
            for doc, k, text, n_keys, marks, hot in rows_of(batches, "doc_id", "_k", "text", "n_keys", "marks", "hot"):
                words = utf8(text).split()
                key, first, last = anchors(memo.of(words), window)
                at, hot = np.flatnonzero(shared.bits_of(marks, n_keys)), shared.bits_of(hot, n_keys)
                for a, f, e, h in zip(key[at].tolist(), first[at].tolist(), (last[at] + window).tolist(), hot[at].tolist(), strict=True):
                    content = b" ".join(words[f:e])
                    n += len(content) + 100
                    collapse(held, (a, content, h), NO_ID if doc is None else doc, [(doc, k, f, e)], removed)
                if n >= HELD:
                    yield from flush(held, removed)
                    release()
                    held, removed, n = {}, defaultdict(list), 0
            yield from flush(held, removed)

        yield from in_batches(rows(), schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            shards: dict[int, list[bytes]] = defaultdict(list)
            for s, doc, k, spans in rows_of(batches, "shard", "doc_id", "_k", "spans"):
                if s is None:
                    yield doc, k, spans
                else:
                    shards[s].append(spans)
            while shards:
                _, parts = shards.popitem()
                held, removed = {}, defaultdict(list)
                while parts:
                    for anchor, words, doc, places in unpacked(parts.pop()):
                        collapse(held, (anchor, words), doc, places, removed)
                by_anchor = defaultdict(list)
                for (anchor, words), own in held.items():
                    by_anchor[anchor].append((words, own))
                several = [x for group in by_anchor.values() if len(group) > 1 for x in group]
                if several:
                    for s, firsts in earlier_windows([(words, own[0]) for words, own in several], window):
                        for d, k, a, _ in several[s][1][1]:
                            removed[d, k] += [(a + f, a + f + window) for f in firsts.tolist()]
                yield from shared.span_rows(removed)

        yield from in_batches(rows(), shared.SPANS)

    # in a fixed order: a task that is run again after an executor's loss makes the same batches
    marked = marked.select("doc_id", "_k", "text", "n_keys", "marks", "hot").sortWithinPartitions("doc_id", "_k")
    # removed spans have no shard: they are dealt out by document
    return dealt(marked.mapInArrow(gather, ddl), F.coalesce("shard", F.col("_k")), tasks).mapInArrow(search, shared.SPANS_DDL)


def with_removed(docs: DataFrame, window: int) -> DataFrame:
    """``docs`` (with doc_id, _k, text) and _spans: parts of the word spans to remove, or null."""

    def describe():  # noqa: ANN202
        memo = WordHashes()
        return lambda text: (anchors(memo.of(utf8(text).split()), window)[0], b"")

    tasks = tasks_for(docs)
    marks = cut(shared.shared_keys(docs, describe, tasks=tasks).drop("extra").dropDuplicates(["doc_id", "_k"]))
    maybe, _ = shared.split_by(docs.select("doc_id", "_k", "text"), marks)
    return shared.with_spans(docs, spans_of(shared.with_rows(maybe, marks), window, tasks))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc, text, parts in rows_of(batches, "doc_id", "text", "_spans"):
                words = utf8(text).split()
                spans = shared.read_spans(parts)
                kept = [w for a, b in pairs_between(spans, len(words)) for w in words[a:b]]
                yield doc, len(words), len(words) - len(kept), shared.sha(b" ".join(kept))

        yield from in_batches(rows(), schema, 4096)

    return with_removed(keyed(docs), window).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def pairs_between(spans: np.ndarray, n: int) -> list[tuple[int, int]]:
    """What lies between the spans, within 0 to n."""
    edges = np.concatenate([[0], spans.ravel(), [n]]).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with all columns; texts lose the repeated words (a changed text has one space between words), and n_chars follows."""
    others = [c for c in docs.columns if c != "text"]
    rows = keyed(docs, F.struct(*[F.col(quoted(c)) for c in others]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, parts in rows_of(iter([batch]), "text", "_spans"):
                if parts:
                    words = utf8(text).split()
                    text = b" ".join(w for a, b in pairs_between(shared.read_spans(parts), len(words)) for w in words[a:b]).decode("utf-8", "surrogatepass")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "text"])

    done = with_removed(rows, window).select("_row", "text", "_spans").mapInArrow(run, StructType([rows.schema["_row"], StructField("text", StringType())]))
    columns = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return done.select(*columns)
