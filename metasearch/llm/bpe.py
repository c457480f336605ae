"""BPE encoding and decoding with a distinct-word table.

Texts are split into words by the vocabulary's own pattern. Each map task numbers the distinct words of a block of documents and keeps the documents as
word numbers in order. The words go to word ranges, one row a (block, range); there each distinct word is encoded once, and each block is
answered with its words' ids. Block and answers meet again, ids are joined back by position, and decoding joins each id with its piece.

The tokenizer file is read on the driver; its text (bounded by the vocabulary) travels with the tasks. It must be a byte-level BPE without a normalizer,
a prefix space or added tokens that strip or match single words only; another file is refused.

Defined results: a null or empty text has no ids and decodes to the empty text; special tokens' strings in a text become their ids, as the
library does by default; repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasearch.llm.base import dealt, in_batches, release, rows_of, small_batches, tasks_for
from metasearch.llm.shared import ranges, sha

#: Words, and documents, of a block at most (a document is never split).
BLOCK_WORDS, BLOCK_DOCS = 2_000_000, 1 << 15
#: The split of byte-level BPE, for characters on whose classes all versions of Unicode agree; other texts are split by the library.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = regex.compile(r"[\t\n\x20-\x7E¡-¬®-ɏ]*")
ROWS = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
ROWS_DDL = "route bigint, block bigint, data binary"


def byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in own}
    for i, b in enumerate(b for b in range(256) if b not in own):
        letters[chr(256 + i)] = b
    return letters


def checked(tokenizer: str) -> str:
    """The tokenizer's text, if it is one that splitting and decoding here follow."""
    j = json.loads(tokenizer)
    pre, decoder = j.get("pre_tokenizer") or {}, j.get("decoder") or {}
    odd = [t["content"] for t in j.get("added_tokens", ()) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    for wrong, what in (
        (j["model"].get("type") != "BPE" or j["model"].get("byte_fallback") or j["model"].get("continuing_subword_prefix") or j["model"].get("end_of_word_suffix"), "its model isn't a plain byte-level BPE"),
        (j.get("normalizer") is not None, "it has a normalizer"),
        (pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or decoder.get("type") != "ByteLevel", "it isn't split and decoded by bytes"),
        (pre.get("add_prefix_space"), "it adds a space before the text"),
        (odd, f"added tokens take more than their text: {odd[:3]}"),
    ):
        if wrong:
            raise ValueError(f"this tokenizer isn't supported: {what}")
    return tokenizer


def pieces(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes by id, and where each begins."""
    j, letters = json.loads(tokenizer), byte_letters()
    size = 1 + max([*j["model"]["vocab"].values(), *(t["id"] for t in j["added_tokens"])])
    found = [b""] * size
    for piece, i in j["model"]["vocab"].items():
        found[i] = bytes(map(letters.__getitem__, piece))
    for t in j["added_tokens"]:
        found[t["id"]] = t["content"].encode()
    return np.frombuffer(b"".join(found), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, size))])


class Splitter:
    """Words of a text, as the library's pre-tokenizer cuts them, special tokens apart."""

    def __init__(self, tokenizer: str) -> None:
        self.tokenizer = tokenizer
        special = [t["content"] for t in json.loads(tokenizer)["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.names = set(special)

    @functools.cached_property
    def library(self):  # noqa: ANN202
        """Loaded for the first text that needs it: it takes tens of MB."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.tokenizer)

    def plain(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return [w for part in self.special.split(text) for w in ([part] if part in self.names else self.plain(part))]


def planes(numbers: np.ndarray) -> list[bytes]:
    """Numbers below 2**24 as three compressed byte planes."""
    z = zstandard.ZstdCompressor(level=3)
    return [z.compress((numbers >> s & 0xFF).astype(np.uint8).tobytes()) for s in (0, 8, 16)]


def from_planes(parts: list[bytes]) -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    low, mid, high = (np.frombuffer(z.decompress(p), np.uint8).astype(np.int64) for p in parts)
    return low | mid << 8 | high << 16


def gathered(flat: np.ndarray, start: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i + 1]] for each i in ``which``, one after the other."""
    n = start[which + 1] - start[which]
    if not len(n):
        return flat[:0]
    at = np.repeat(start[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return flat[at + np.arange(len(at))]


def encoded(docs: DataFrame, path: str, finish: Callable[[np.ndarray, bytes], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """One row a document: doc_id and what ``finish`` makes of its ids and of the bytes they decode to."""
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        own = checked(f.read())
    tokenizer = docs.sparkSession.sparkContext.broadcast(own)
    tasks = tasks_for(docs)
    n_ranges = ranges(tasks)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: int, number: dict[str, int], ids: list, parts: list[np.ndarray]) -> Iterator[tuple]:
            numbers = np.concatenate(parts) if parts else np.empty(0, np.int64)
            # frequent words get small numbers: their planes compress
            by_count = np.argsort(-np.bincount(numbers, minlength=len(number)), kind="stable")
            rank = np.empty(len(number), np.int64)
            rank[by_count] = np.arange(len(number))
            words = list(number)
            words = [words[i] for i in by_count.tolist()]
            yield None, block, pickle.dumps((ids, np.array([len(p) for p in parts], np.int64), planes(rank[numbers]), zstandard.ZstdCompressor(level=3).compress(pickle.dumps(words))))

        def rows() -> Iterator[tuple]:
            s = Splitter(tokenizer.value)
            block, number, ids, parts, n = TaskContext.get().partitionId() << 24, {}, [], [], 0
            for doc, text in rows_of(batches, "doc_id", "text"):
                words = s.split(text) if text else []
                for w in dict.fromkeys(words):
                    if w not in number:
                        number[w] = len(number)
                ids.append(doc)
                parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)).astype(np.uint32))
                n += len(words)
                if n >= BLOCK_WORDS or len(ids) >= BLOCK_DOCS:
                    yield from flush(block, number, ids, parts)
                    block, number, ids, parts, n = block + 1, {}, [], [], 0
                    release()
            if ids:
                yield from flush(block, number, ids, parts)

        yield from in_batches(rows(), ROWS, most_bytes=1 << 20)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each block by range; their numbers go along, so that answers can be put in place."""

        def rows() -> Iterator[tuple]:
            for block, data in rows_of(batches, "block", "data"):
                words = pickle.loads(zstandard.ZstdDecompressor().decompress(pickle.loads(data)[3]))
                by_range = defaultdict(lambda: ([], []))
                for i, w in enumerate(words):
                    at = by_range[xxhash.xxh32_intdigest(w) & (n_ranges - 1)]
                    at[0].append(i)
                    at[1].append(w)
                for r, (numbers, own) in by_range.items():
                    yield r, block, zstandard.ZstdCompressor(level=3).compress(pickle.dumps((np.array(numbers, np.uint32), "\0".join(own) if "\0" not in "".join(own) else own)))

        yield from in_batches(rows(), ROWS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t, held = Tokenizer.from_str(tokenizer.value), defaultdict(list)
            t.no_truncation()
            t.no_padding()
            for route, block, data in rows_of(batches, "route", "block", "data"):
                held[route].append((block, data))
            while held:
                asked = [(b, *pickle.loads(zstandard.ZstdDecompressor().decompress(d))) for b, d in held.popitem()[1]]
                asked = [(b, numbers, w.split("\0") if isinstance(w, str) else w) for b, numbers, w in asked]
                table = {w: None for _, _, own in asked for w in own}
                words = list(table)
                for at in range(0, len(words), 20_000):
                    part = words[at : at + 20_000]
                    table.update(zip(part, (np.array(e.ids, np.uint32) for e in t.encode_batch(part, add_special_tokens=False)), strict=True))
                for b, numbers, own in asked:
                    ids = [table[w] for w in own]
                    yield None, b, zstandard.ZstdCompressor(level=3).compress(pickle.dumps((numbers, np.array([len(x) for x in ids], np.uint16 if max(map(len, ids)) < 65536 else np.uint32), np.concatenate(ids))))

        yield from in_batches(rows(), ROWS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            piece = pieces(tokenizer.value)
            for data, answers in rows_of(batches, "data", "answers"):
                docs, counts, numbers, _ = pickle.loads(data)
                numbers = from_planes(numbers)
                got = [pickle.loads(zstandard.ZstdDecompressor().decompress(a)) for a in answers or ()]
                lengths = np.zeros(sum(len(g[0]) for g in got), np.int64)
                for word, n, _ in got:
                    lengths[word] = n
                start = np.concatenate([[0], np.cumsum(lengths)])
                flat = np.empty(start[-1], np.uint32)
                for word, n, ids in got:
                    n = n.astype(np.int64)
                    at = np.repeat(start[word] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                    flat[at + np.arange(len(ids))] = ids
                for doc, own in zip(docs, np.split(numbers, np.cumsum(counts)[:-1]), strict=True):
                    ids = gathered(flat, start, own)
                    yield doc, *finish(ids, gathered(*piece, ids).tobytes())

        yield from in_batches(rows(), schema, 2048)

    # dealt by block once: the join and the gathering of answers use the same partitions
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, ROWS_DDL).select("block", "data").repartition(tasks, "block")
    answers = dealt(blocks.mapInArrow(words_of, ROWS_DDL), "route", tasks).mapInArrow(encode, ROWS_DDL)
    answers = answers.select(F.col("block").alias("_block"), "data").repartition(tasks, "_block").groupBy("_block").agg(F.collect_list("data").alias("answers"))
    return blocks.join(answers.hint("merge"), F.col("block") == F.col("_block"), "left").select("data", "answers").mapInArrow(place, ddl)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def finish(ids: np.ndarray, data: bytes) -> tuple:
        return len(ids), sha(ids.astype("<u4").tobytes()), sha(data.decode("utf-8", "replace").encode())

    return encoded(docs, path or default_path(), finish, schema, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), text as decoded from the ids, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def finish(ids: np.ndarray, data: bytes) -> tuple:
        return len(ids), ids.astype(np.int32), data.decode("utf-8", "replace")

    return encoded(docs, path or default_path(), finish, schema, "doc_id bigint, n_tokens bigint, ids array<int>, text string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
