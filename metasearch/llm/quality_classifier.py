"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then calibrated views are combined.

Both views are naive Bayes models over the presence of hashed features. The text view sees words; the metadata view sees language, source, size class and the
page's layout in classes (lines, words a line, repeated lines and words, shares of symbols and capitals). A feature's weight is its log rate
among good rows over that among the others, smoothed; features whose rates differ by chance (fewer than ``significant`` standard deviations) have none.

Both start from labelled rows. In each round a view's confident calls (calibrated probability of ``confident`` or more for either class) on **all** rows
without a label become labels of the other view, whose rates are counted again: one pass over all rows, sums only. Rates are taken within each
class, so a view that is sure of one class only doesn't shift the balance. Calibration and the combination are fitted on labelled rows kept
apart (every fourth of each class); of its rounds each view keeps the one with the least log loss there. Every row is scored.

At most ``labelled`` labelled rows are used, chosen by a hash of the id; nothing else is bounded. The same is done for the ``toxic`` label. A
document is kept if it is rather good and rather not toxic.

Defined results: rows without id, text or metadata are scored by what they have (empty text: no words); several labels of one id count by
their majority (a tie is 1); a label with fewer than two rows of either class gives every row the share of its ones, 0.5 without any, and ``kept`` follows;
repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasearch.llm.base import U64, WordHashes, cut, in_batches, rows_of, small_batches, utf8
from metasearch.llm.decontamination import FOLD

#: Hashed features of each view: text, metadata.
BITS = 16, 12
SIZES = 1 << BITS[0], 1 << BITS[1]
SYMBOLS = b"#*$%&|<>!@=_~^{}[]\\"
SHARES = [0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.7]
NUMBERS = [1, 2, 4, 6, 8, 12, 16, 24, 32, 48, 64]
#: Numbers in one row of sums, and the groups in which sums of tasks meet first.
CHUNK, GROUPS = 1 << 14, 64


@dataclass(frozen=True)
class Fit:
    """Parameters of the fit."""

    labelled: int = 20_000
    rounds: int = 3
    confident: float = 0.97
    #: What a row told by the other view weighs beside a labelled one.
    told: float = 0.5
    smoothing: float = 2.0
    significant: float = 4.0


@dataclass
class Model:
    """Of one label. ``views``: the weights of each view's features, and (slope, intercept) of its calibration."""

    constant: float | None = None
    views: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    mix: np.ndarray | None = None

    def of_views(self, sums: list[np.ndarray]) -> list[np.ndarray]:
        """The calibrated logits of each view from its sums of weights."""
        return [z * scale[0] + scale[1] for z, (_, scale) in zip(sums, self.views, strict=True)]

    def scores(self, sums: list[np.ndarray]) -> np.ndarray:
        a, b = self.of_views(sums)
        return sigmoid(a * self.mix[0] + b * self.mix[1] + self.mix[2])


def text_features(text: str | None, memo: WordHashes) -> np.ndarray:
    """Buckets of the distinct words."""
    words = utf8(text).translate(FOLD).split()
    return np.unique(memo.of(words) >> U64(64 - BITS[0])).astype(np.int32)


def meta_features(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Buckets of the metadata and of the page's layout."""
    data = utf8(text)
    lines, words, n = [x for x in data.split(b"\n") if x.strip()], data.split(), max(1, len(data))
    level = lambda x, edges: str(int(np.searchsorted(edges, x))).encode()
    keys = [
        b"lang:" + utf8(lang), b"source:" + utf8(source), b"size:" + (str(int(math.log2(n_chars + 1))).encode() if n_chars is not None and n_chars >= 0 else b""),
        b"symbols:" + level((n - len(data.translate(None, SYMBOLS))) / n, SHARES), b"capitals:" + level((n - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / n, SHARES),
        b"lines:" + level(len(lines), NUMBERS), b"line words:" + level(len(words) / max(1, len(lines)), NUMBERS),
        b"line repeats:" + level(1 - len(set(lines)) / max(1, len(lines)), SHARES), b"word repeats:" + level(1 - len(set(words)) / max(1, len(words)), SHARES),
    ]
    return np.array([xxhash.xxh64_intdigest(k) >> 64 - BITS[1] for k in keys], np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of y on the columns of x and 1, by Newton steps with a little ridge."""
    size = np.maximum(1e-9, np.abs(x).max(0)) if len(x) else np.ones(x.shape[1])
    x = np.column_stack([x / size, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(30):
        p = sigmoid(x @ b)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(len(b))
        b -= np.linalg.solve(h, x.T @ (p - target) + 1e-3 * b)
    return b / np.append(size, 1)


def log_loss(logit: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(sigmoid(logit), 1e-9, 1 - 1e-9)
    return float(-np.mean(np.where(y > 0.5, np.log(p), np.log(1 - p))))


def weights(ones: np.ndarray, zeros: np.ndarray, n_ones: float, n_zeros: float, fit: Fit) -> np.ndarray:
    """A feature's log rate among ones over that among zeros, from (weighted) counts; 0 where the rates may be equal."""
    rate = (ones + zeros + 1e-9) / (n_ones + n_zeros)
    a, b = (ones + fit.smoothing * rate) / (n_ones + fit.smoothing), (zeros + fit.smoothing * rate) / (n_zeros + fit.smoothing)
    deviation = np.sqrt(rate * np.maximum(1e-9, 1 - rate) * (1 / n_ones + 1 / n_zeros) + 0.25 * (1 / n_ones**2 + 1 / n_zeros**2))
    return np.where(np.abs(ones / n_ones - zeros / n_zeros) >= fit.significant * deviation, np.log(a / b), 0.0).astype(np.float32)


def sums_of(found: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """The sum of the weights of each row's features."""
    if not found:
        return np.empty(0)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.bincount(np.repeat(np.arange(len(found)), sizes), weight[np.concatenate(found)], len(found))


class Told(dict):
    """doc_id -> (quality, toxic, apart for quality, apart for toxic) of the labelled rows in use; None where a label is null."""

    def __init__(self, rows: list[tuple]) -> None:
        super().__init__()
        for c in (0, 1):  # every fourth of each class is kept apart
            seen = [0, 0]
            for doc, *y in rows:
                if y[c] is not None:
                    own = self.setdefault(doc, [None, None, False, False])
                    own[c], own[2 + c] = y[c], seen[y[c]] % 4 == 1
                    seen[y[c]] += 1

    def fits(self, c: int) -> bool:
        return all(any(own[c] == y and own[2 + c] == apart for own in self.values()) for y in (0, 1) for apart in (False, True))

    def constant(self, c: int) -> float:
        y = [own[c] for own in self.values() if own[c] is not None]
        return sum(y) / len(y) if y else 0.5


def chosen(labels: DataFrame, most: int) -> Told:
    """At most ``most`` labelled ids, by hash; no more reach the driver."""
    each = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("q"), F.avg(F.col("toxic").cast("double")).alias("t"))
    rows = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return Told([(r["doc_id"], *(None if y is None else int(y >= 0.5) for y in (r["q"], r["t"]))) for r in rows])


FEATURES = pa.schema([("doc_id", pa.int64()), ("apart", pa.bool_()), ("told", pa.bool_()), ("text", pa.binary()), ("meta", pa.binary())])
SUMS = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("sums", pa.binary())])
#: Of a pass: for each label and class the counts of both views' features, then how many rows (in weights) each view was told.
WIDTH = 2 * 2 * (sum(SIZES) + 2)


def featured(docs: DataFrame, told: Told) -> DataFrame:
    """doc_id, apart, told, and the features of both views, for every row; written once, read by each round."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(dict(told)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = WordHashes(), pickle.loads(shared.value)

        def rows() -> Iterator[tuple]:
            for doc, text, lang, source, n in rows_of(batches, "doc_id", "text", "lang", "source", "n_chars"):
                own = known.get(doc)
                yield doc, own is not None and (own[2] or own[3]), own is not None, text_features(text, memo).tobytes(), meta_features(text, lang, source, n).tobytes()

        yield from in_batches(rows(), FEATURES, 4096)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return cut(docs.mapInArrow(run, "doc_id bigint, apart boolean, told boolean, text binary, meta binary"))


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[np.ndarray]]]]:
    """(ids, features of each view) of a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part.column(0).to_pylist(), [[np.frombuffer(x, np.int32) for x in part.column(part.schema.get_field_index(v)).to_pylist()] for v in ("text", "meta")]


def summed(parts: DataFrame, key: str) -> DataFrame:
    """The sums of the rows of each ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for k, data in rows_of(batches, key, "sums"):
            own = np.frombuffer(data, np.float64)
            total[k] = total[k] + own if k in total else own.copy()
        yield from in_batches(((k // GROUPS if key == "part" else k, k, x.tobytes()) for k, x in total.items()), SUMS)

    return parts.repartition(key).mapInArrow(run, "key bigint, part bigint, sums binary")


def counted(rows: DataFrame, told: Told, models: list[Model] | None, fit: Fit) -> np.ndarray:
    """The counts of one pass (WIDTH numbers): labelled rows, and with ``models`` also the rows that the views call with confidence."""
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps((dict(told), models)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, models = pickle.loads(shared.value)
        total = np.zeros(WIDTH)
        for ids, found in parts_of(batches):
            known = [told.get(d) for d in ids]
            for c in (0, 1):
                labelled = np.array([own is not None and own[c] is not None for own in known])
                learn = np.array([float(own is not None and own[c] is not None and not own[2 + c]) for own in known])
                y = np.array([own[c] if own is not None and own[c] else 0 for own in known])
                weight = [np.stack([learn * (y == k) for k in (0, 1)]) for _ in (0, 1)]
                if models is not None and models[c].constant is None:
                    calls = [sigmoid(x) for x in models[c].of_views([sums_of(f, w) for f, (w, _) in zip(found, models[c].views, strict=True)])]
                    for v in (0, 1):  # each view is told by the other
                        p = calls[1 - v]
                        for k, sure in ((0, p <= 1 - fit.confident), (1, p >= fit.confident)):
                            weight[v][k] += fit.told * (sure & ~labelled)
                for k in (0, 1):
                    at = (2 * c + k) * (sum(SIZES) + 2)
                    for v in (0, 1):
                        sizes = np.fromiter(map(len, found[v]), np.int64, len(ids))
                        total[at : at + SIZES[v]] += np.bincount(np.concatenate(found[v]), np.repeat(weight[v][k], sizes), SIZES[v])
                        at += SIZES[v]
                    total[at : at + 2] += weight[0][k].sum(), weight[1][k].sum()
        part = TaskContext.get().partitionId()
        yield from in_batches(((k, k * GROUPS + part % GROUPS, x.tobytes()) for k in range(-(-WIDTH // CHUNK)) if (x := total[k * CHUNK : (k + 1) * CHUNK]).any()), SUMS)

    rows = rows if models is not None else rows.filter("told")
    parts = rows.select("doc_id", "text", "meta").mapInArrow(run, "key bigint, part bigint, sums binary")
    total = np.zeros(WIDTH)
    # bounded: WIDTH numbers
    for r in summed(summed(parts, "part"), "key").collect():
        own = np.frombuffer(r["sums"], np.float64)
        total[r["key"] * CHUNK : r["key"] * CHUNK + len(own)] = own
    return total.reshape(2, 2, -1)


def models(rows: DataFrame, told: Told, fit: Fit, log: list | None = None) -> list[Model]:
    """The models for quality and toxic from ``featured`` rows. ``log`` takes a dict a round and label: weights told to each view, log losses."""
    if not any(told.fits(c) for c in (0, 1)):
        return [Model(constant=told.constant(c)) for c in (0, 1)]
    # bounded: a quarter of the labelled rows, with one row an id
    apart = rows.filter("apart").dropDuplicates(["doc_id"]).select("doc_id", "text", "meta").toArrow().sort_by("doc_id")
    ids = apart["doc_id"].to_pylist()
    found = [[np.frombuffer(x, np.int32) for x in apart[v].to_pylist()] for v in ("text", "meta")]
    own = [np.array([told[d][2 + c] for d in ids], bool) for c in (0, 1)]
    y = [np.array([told[d][c] or 0 for d in ids], float) for c in (0, 1)]
    now: list[Model] | None = None
    best: list[list[tuple[float, np.ndarray, np.ndarray]]] = [[(math.inf,), (math.inf,)] for _ in (0, 1)]
    for step in range(fit.rounds + 1):
        counts = counted(rows, told, now, fit)
        now = []
        for c in (0, 1):
            n = counts[c, :, -2:]
            if not told.fits(c) or not own[c].any() or len(set(y[c][own[c]])) < 2 or not n.all():
                now.append(Model(constant=told.constant(c)))
                continue
            model, at = Model(), 0
            for v in (0, 1):
                w = weights(counts[c, 1, at : at + SIZES[v]], counts[c, 0, at : at + SIZES[v]], n[1, v], n[0, v], fit)
                at += SIZES[v]
                z = sums_of(found[v], w)[own[c]]
                scale = platt(z[:, None], y[c][own[c]])
                model.views.append((w, scale))
                best[c][v] = min(best[c][v], (log_loss(z * scale[0] + scale[1], y[c][own[c]]), w, scale), key=lambda x: x[0])
                if log is not None:
                    log.append({"round": step, "label": c, "view": v, "told": n[:, v].tolist(), "loss": log_loss(z * scale[0] + scale[1], y[c][own[c]])})
            now.append(model)
    for c, model in enumerate(now):
        if model.constant is None:
            model.views = [x[1:] for x in best[c]]
            sums = [sums_of(f, w)[own[c]] for f, (w, _) in zip(found, model.views, strict=True)]
            model.mix = platt(np.column_stack(model.of_views(sums)), y[c][own[c]])
    return now


def quality_scores(docs: DataFrame, labels: DataFrame, fit: Fit | None = None, log: list | None = None) -> DataFrame:
    """doc_id, score (good), toxic_score, kept for every row."""
    fit = fit or Fit()
    small_batches(docs.sparkSession)
    told = chosen(labels, fit.labelled)
    rows = featured(docs, told)
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models(rows, told, fit, log)))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("toxic_score", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pickle.loads(shared.value)

        def rows() -> Iterator[tuple]:
            for ids, found in parts_of(batches):
                good, toxic = (np.full(len(ids), m.constant) if m.constant is not None else m.scores([sums_of(f, w) for f, (w, _) in zip(found, m.views, strict=True)]) for m in both)
                yield from zip(ids, good.tolist(), toxic.tolist(), ((good >= 0.5) & (toxic <= 0.5)).tolist(), strict=True)

        yield from in_batches(rows(), schema, 4096)

    return rows.select("doc_id", "text", "meta").mapInArrow(run, "doc_id bigint, score double, toxic_score double, kept boolean")
