"""Quality rules by tokeniser fertility, with a few word and line counts as base rules.

A public vocabulary (sentencepiece BPE with byte fallback) tells how text-like a text is: code points a token, the share of byte-fallback
tokens, and the entropy of its tokens in bits. Each script has a band for each measure; a text outside one is rejected. Words repeat, so a worker encodes each
word once and keeps its pieces (bounded memo); the counts of a text are sums over its words. Every whole text is measured.

A vocabulary splits letters it seldom met into more pieces, so the Latin band widens with the share of letters with marks (letters beyond ASCII and
combining marks, of all letters). Letters in random order come in small pieces, too, but these are all alike often, while a thinly covered language
repeats the pieces of its common words: near the floor of fertility the band has a lower entropy ceiling. Characters that no text has (private use,
unassigned, C1 controls, U+FFFD) reject it in any script.

Defined results: a null or wordless text has zeros and fails the base rule; repeated rows are judged alike; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from metasearch.llm.base import in_batches, release, rows_of, small_batches, utf8

#: Symbols counted by n_symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Words, and their bytes, whose pieces one Python worker keeps before it starts anew.
MEMO, MEMO_BYTES = 300_000, 16 << 20


@dataclass(frozen=True)
class Band:
    """A text stays while each measure lies within its bounds."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float]
    #: What a marks share of 1 takes from the floor of chars_per_token, adds to byte_share and takes from the entropy floor.
    marked: tuple[float, float, float] = (0.0, 0.0, 0.0)
    #: Below so many characters a token (marks added as above) entropy is at most so much at ``entropy_full`` tokens, and so much more for twice as many.
    thin: tuple[float, float, float] = (0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Rules:
    """Parameters. Bands go by the script that most letters have; ``other`` holds for the rest.

    The entropy floor grows with the text up to ``entropy_full`` tokens: a short text cannot have high entropy. Clean texts of 19 Latin-script
    languages and spellings stand above the Latin floors; the lowest without marks had 1.63 characters a token. Random letters have 1.42 to 1.63, with 6.4
    bits and more from 200 tokens on, where clean texts of less than 1.7 have 5.8.
    """

    least_words: int = 50
    most_repeat_percent: int = 50
    entropy_full: int = 256
    most_not_text: float = 0.03
    bands: dict[str, Band] = field(default_factory=lambda: {
        "latin": Band((1.56, 9.0), 0.20, (5.0, 14.0), (1.9, 0.3, 1.5), (1.7, 6.4, 0.25)),
        "cyrillic": Band((1.2, 8.0), 0.25, (5.0, 14.0)),
        "greek": Band((0.6, 6.0), 0.60, (4.0, 14.0)),
        "arabic": Band((0.6, 6.0), 0.60, (4.0, 14.0)),
        "han": Band((0.3, 4.0), 0.90, (4.0, 14.0)),
        "other": Band((0.2, 9.0), 1.00, (3.0, 14.0)),
    })


SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in ("Latin", "Cyrillic", "Greek", "Arabic", "Han")}
NOT_ASCII = regex.compile(r"[^\x00-\x7F]")


def script_of(text: str) -> str:
    """The script with most of the letters; latin at once if no character is beyond it."""
    if not NOT_ASCII.search(text) or ord(max(text)) < 0x250:
        return "latin"
    counts = {name.lower(): len(p.findall(text)) for name, p in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


#: What may be a mark or a character that no text has, or a letter outside Latin; without it, a text that fits the unwidened band is kept as it is.
ODD = regex.compile(r"[^\x00-\x7F\x85\xA0-\u024F\u2010-\u2027\u20AC]")
ASCII_OTHERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))


@functools.lru_cache(1 << 16)
def kind_of(c: str) -> str:
    """The kind of a character beyond ASCII: L(etter), M(ark), X (no text has it) or any other."""
    category = unicodedata.category(c)
    return "X" if category in ("Co", "Cn", "Cc", "Cs") and c != "\x85" or c == "\ufffd" else category[0]


def beyond_ascii(text: str, data: bytes) -> tuple[float, float]:
    """(marks share of the letters, share of the characters that no text has)."""
    kinds = Counter()
    for c, n in Counter(NOT_ASCII.findall(text)).items():
        kinds[kind_of(c)] += n
    letters = len(data.translate(None, ASCII_OTHERS)) + kinds["L"]
    return min(1.0, (kinds["L"] + kinds["M"]) / max(1, letters)), kinds["X"] / len(text)


#: Words that normalization leaves as one word each, whatever stands beside them: they are encoded in one go.
PLAIN = regex.compile(r"[!-~\u00C0-\u024F ]*")


class Pieces:
    """Word numbers and their pieces, by one encoding of each word. ``model``: the bytes of a sentencepiece model."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.sp.get_piece_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(size)])
        self.begins = np.array([self.sp.id_to_piece(i).startswith("\u2581") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes, self.used = 0, 0
        self.flat, self.start = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, how many each word has)."""
        text = " ".join(words)
        if PLAIN.fullmatch(text):
            flat = np.array(self.sp.encode(text), np.int32)
            at = np.flatnonzero(self.begins[flat])
            if len(at) == len(words):
                return flat, np.diff(np.append(at, len(flat)))
        ids = self.sp.encode(words, num_threads=1)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths

    def of(self, words: list[bytes]) -> np.ndarray:
        """A number for each word; equal words have equal numbers. Numbers hold until the next call."""
        if len(self.number) > MEMO or self.bytes > MEMO_BYTES:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            self.bytes += sum(map(len, new))
            n = len(self.number)
            flat, lengths = self.encoded([w.decode("utf-8", "replace") for w in new])
            self.number.update(zip(new, range(n, n + len(new)), strict=True))
            if self.used + len(flat) > len(self.flat):
                self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + len(flat)))
            if n + len(new) >= len(self.start):
                self.start = np.resize(self.start, 2 * (n + len(new)))
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[n + 1 : n + len(new) + 1] = self.used + np.cumsum(lengths)
            self.used += len(flat)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        """The pieces of the numbered words, one word after the other."""
        n = self.start[numbers + 1] - self.start[numbers]
        at = np.repeat(self.start[numbers] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return self.flat[at + np.arange(len(at))]


def repeat_words(numbers: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(numbers) < 4:
        return 0
    k = np.int64(numbers.max() + 1)
    pairs = numbers[:-1] * k + numbers[1:]
    if k < 2_000_000:  # k ** 3 fits 63 bits
        windows = pairs[:-1] * k + numbers[2:]
    else:
        windows = np.unique(pairs, return_inverse=True)[1][:-1] * k + numbers[2:]
    order = np.argsort(windows, kind="stable")
    same = np.flatnonzero(np.diff(windows[order]) == 0)
    if not len(same):
        return 0
    hit = np.zeros(len(numbers), bool)
    for i in range(3):
        hit[order[same] + i] = hit[order[same + 1] + i] = True
    return int(hit.sum())


def measured(text: str | None, pieces: Pieces, rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_per_token, byte_share, entropy, script."""
    data = utf8(text)
    words = data.split()
    if not words:
        return 0, 0, 0, 0, 0, True, False, 0.0, 0.0, 0.0, "other"
    chars = len(text) - sum(text.count(chr(c)) for c in SPACES)
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    numbers = pieces.of(words)
    repeats = repeat_words(numbers)
    tokens = pieces.tokens(numbers)
    per_token = chars / len(tokens)
    byte_share = float(pieces.is_byte[tokens].mean())
    counts = np.bincount(tokens)
    share = counts[counts > 0] / len(tokens)
    entropy = float(-(share * np.log2(share)).sum())
    base_failed = len(words) < rules.least_words or 100 * repeats > rules.most_repeat_percent * len(words)
    script = script_of(text)
    band = rules.bands.get(script, rules.bands["other"])
    short = min(1.0, np.log2(len(tokens) + 1) / np.log2(rules.entropy_full))

    def fits(marks: float) -> bool:
        wide, more_bytes, less_entropy = (marks * x for x in band.marked)
        thin, most, growth = band.thin
        ceiling = most + growth * np.log2(len(tokens) / rules.entropy_full) if per_token + wide < thin else band.entropy[1]
        return band.chars_per_token[0] <= per_token + wide and per_token <= band.chars_per_token[1] and byte_share <= band.byte_share + more_bytes and (band.entropy[0] - less_entropy) * short <= entropy <= ceiling

    good = fits(0.0)
    if not base_failed and len(data) > len(text) and (not good or ODD.search(text)):
        marks, not_text = beyond_ascii(text, data)
        good = fits(marks) and not_text <= rules.most_not_text
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, base_failed, bool(not base_failed and good), per_token, byte_share, entropy, script


MEASURES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string())])
DDL = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double, script string"


def quality_rules(docs: DataFrame, model: str | None = None, rules: Rules | None = None) -> DataFrame:
    """One row a document: its measures and verdict. ``model``: path of a sentencepiece model; the driver reads it."""
    shared, rules = sent(docs, model), rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        yield from in_batches(((d, *measured(t, pieces, rules)) for d, t in rows_of(batches, "doc_id", "text")), MEASURES)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, DDL)


def passing(docs: DataFrame, model: str | None = None, rules: Rules | None = None) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    shared, rules = sent(docs, model), rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            texts = (t for (t,) in rows_of(iter([batch]), "text"))
            yield batch.filter(pa.array([measured(t, pieces, rules)[6] for t in texts], pa.bool_()))
        del pieces
        release()

    return docs.mapInArrow(run, docs.schema)


def sent(docs: DataFrame, model: str | None) -> Broadcast:
    """The model's bytes on all executors (bounded by its vocabulary)."""
    small_batches(docs.sparkSession)
    with open(model or default_model(), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
