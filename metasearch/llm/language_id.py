"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts hashed n-grams by language on the executors and sums them in Spark; the driver gets the log probabilities in matrices of
BUCKETS rows and LANGUAGES columns at most, and broadcasts each; more languages make more matrices. Scoring is sparse and in numpy: the n-grams of a batch of
texts are hashed, each distinct (text, bucket) with its count picks a row of the matrix, and the products are added up by text. A long text is
counted piece by piece, so what is held doesn't grow with it.

Learning uses at most ``train_rows`` labelled rows (by hash of the id, whole texts); each row is scored.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if nothing could be learned; equal scores go to
the first language in order; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasearch.llm.base import U64, cut, gram_hashes, in_batches, rows_of, small_batches

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Most labelled rows to learn from.
TRAIN_ROWS = 200_000
#: Languages of one broadcast matrix.
LANGUAGES = 256
#: Characters whose n-grams are held at a time.
PIECE = 1 << 18
#: Products of counts and log probabilities held at a time.
PRODUCTS = 1 << 20
SMOOTHING = 0.5
LETTER = regex.compile(r"\p{L}")
#: ASCII characters that aren't letters become spaces; A-Z become lower case.
FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
FOLD[65:91] += 32


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, piece by piece."""
    before = np.empty(0, np.uint32)
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code < 128, FOLD[np.minimum(code, 127)], code)
        last = np.concatenate([before[-1:], code])
        # one space for several in a row, also across pieces
        code = code[np.concatenate([np.ones(len(code) + 1 - len(last), bool), (last[1:] != 32) | (last[:-1] != 32)])]
        wide = np.concatenate([before, code]).astype(U64)
        # n-grams that end in this piece
        yield np.concatenate([gram_hashes(wide[max(0, len(before) + 1 - n) :], n) >> U64(48) for n in ORDERS]).astype(np.int32)
        before = wide[-(max(ORDERS) - 1) :].astype(np.uint32)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, how often the text has them)."""
    if len(text) <= PIECE:
        return np.unique(next(grams(text), np.empty(0, np.int32)), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for g in grams(text):
        total += np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def learned(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """(languages, log probabilities in matrices [BUCKETS, up to LANGUAGES], log priors) from rows of (doc_id, text, lang)."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    if n > train_rows:
        share = int(train_rows / n * 1_000_000)
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, t in totals.items():
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at])], schema=schema)
            totals.clear()

        for lang, text in rows_of(batches, "lang", "text"):
            if lang not in totals:
                if len(totals) >= LANGUAGES:
                    yield from out()
                totals[lang] = np.zeros(BUCKETS + 1, np.int64)
            buckets, n = counted(text)
            totals[lang][buckets] += n
            totals[lang][BUCKETS] += 1
        yield from out()

    counts = cut(rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # the rows of one language have the number of its texts among them
    languages = sorted(r["lang"] for r in counts.filter(F.col("bucket") == BUCKETS).select("lang").toLocalIterator())
    matrices, documents = [], np.zeros(len(languages))
    for at in range(0, len(languages), LANGUAGES):
        part = languages[at : at + LANGUAGES]
        # bounded: BUCKETS + 1 rows a language; numbers only
        place = F.array_position(F.lit(part), F.col("lang")) - 1
        got = counts.filter((F.col("lang") >= part[0]) & (F.col("lang") <= part[-1])).select(place.cast("int").alias("at"), "bucket", F.col("n").cast("double").alias("n")).toArrow()
        total = np.zeros((BUCKETS + 1, len(part)))
        total[got["bucket"].to_numpy(), got["at"].to_numpy()] = got["n"].to_numpy()
        documents[at : at + len(part)] = total[BUCKETS]
        total = total[:BUCKETS] + SMOOTHING
        matrices.append(np.log(total / total.sum(0)).astype(np.float32))
    return languages, matrices, np.log(np.maximum(documents, 1) / max(1, documents.sum()))


def predicted(rows: DataFrame, model: tuple[list[str], list[np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, held_out (as given), lang_pred, score for rows of (doc_id, held_out, text)."""
    context = rows.sparkSession.sparkContext
    languages, prior = model[0], model[2]
    shared = [context.broadcast(m) for m in model[1]]
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def group(held: list[tuple]) -> Iterator[tuple]:
        found = [counted(t) for _, _, t in held]
        starts = np.concatenate([[0], np.cumsum([len(b) for b, _ in found])])
        bucket, n = np.concatenate([b for b, _ in found]), np.concatenate([n for _, n in found])
        sums = np.tile(prior, (len(held), 1))
        for k, matrix in enumerate(shared):
            weights = matrix.value
            own = sums[:, k * LANGUAGES : k * LANGUAGES + weights.shape[1]]
            step = max(1, PRODUCTS // weights.shape[1])
            for at in range(0, len(bucket), step):  # rows of the sparse counts, some at a time
                first, last = np.searchsorted(starts, [at, min(len(bucket), at + step) - 1], "right") - 1
                edges = np.maximum(starts[first : last + 1], at) - at
                own[first : last + 1] += np.add.reduceat(weights[bucket[at : at + step]] * n[at : at + step, None], edges, axis=0, dtype=np.float64)
        best = sums.argmax(1)
        odds = np.exp(sums - sums.max(1, keepdims=True))
        score = odds.max(1) / odds.sum(1)
        for (doc, out, _), b, s in zip(held, best, score, strict=True):
            yield doc, out, languages[b], float(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, n = [], 0
            for doc, out, text in rows_of(batches, "doc_id", "held_out", "text"):
                if not languages or text is None or not LETTER.search(text):
                    yield doc, out, "und", 0.0
                    continue
                held.append((doc, out, text))
                n += len(text)
                if n >= PIECE or len(held) * len(languages) >= PRODUCTS:
                    yield from group(held)
                    held, n = [], 0
            if held:
                yield from group(held)

        yield from in_batches(rows(), schema, 4096)

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def language_id(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn from the rows that aren't held out, predict all."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", "lang")
    return predicted(rows, learned(rows.filter(~F.col("held_out")), train_rows))
