"""Byte strings, word windows and shingle sets against brute force."""

import hashlib
import random

import pytest

from metasearch.llm import jaccard_join, shared, substring_dedup, suffix_dedup
from tests.llm.conftest import prose, table


def brute_words(rows, window):
    first, out = {}, []
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    least = lambda d: -(1 << 63) if d is None else d
    for d, w in docs:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, 1 << 63), least(d))
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < least(d):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, length):
    first = {}
    docs = [(d, (t or "").encode()) for d, t in rows]
    least = lambda d: -(1 << 63) if d is None else d
    for d, b in docs:
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], (1 << 63, 0)), (least(d), i))
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (least(d), i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), len(b) - len(kept), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(awkward):
    """Awkward rows, a large group of copies with edits, and passages pasted into other texts."""
    r, texts = random.Random(9), list(awkward)
    base, shared = prose(20, 150).split(), [prose(30 + i, 70) for i in range(3)]
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"edit{i}x{r.randrange(99)}"
        texts.append(" ".join(w))
    for i in range(40):
        texts.append(prose(100 + i, r.randrange(5, 60)) + " " + r.choice(shared) + " " + prose(200 + i, r.randrange(60)))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return [*rows, (None, base and " ".join(base)), rows[0], rows[1], rows[1]]


@pytest.mark.parametrize("window", [13, 3, 50])
def test_substring_dedup(spark, awkward, window):
    rows = corpus(awkward)
    assert rows_of(substring_dedup.substring_dedup(table(spark, rows), window)) == brute_words(rows, window)


def test_substring_dedup_in_pieces(spark, awkward, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 50)
    monkeypatch.setattr(substring_dedup, "HELD", 5000)
    rows = corpus(awkward)
    assert rows_of(substring_dedup.substring_dedup(table(spark, rows))) == brute_words(rows, 13)


@pytest.mark.parametrize("hot", [2, 7])
def test_hot_anchors_change_nothing(spark, awkward, monkeypatch, hot):
    monkeypatch.setattr(shared, "HOT", hot)
    monkeypatch.setattr(shared, "BATCH_DOCS", 10)
    rows = [(d, t) for d, t in corpus(awkward) if t is None or len(t) < 9000]
    assert rows_of(suffix_dedup.suffix_dedup(table(spark, rows))) == brute_bytes(rows, 100)
    assert rows_of(substring_dedup.substring_dedup(table(spark, rows))) == brute_words(rows, 13)
    assert rows_of(jaccard_join.ngram_components(table(spark, rows), 3, 9, 10)) == brute_components(rows, 3, 9, 10)


@pytest.mark.parametrize("length", [100, 40])
def test_suffix_dedup(spark, awkward, length):
    rows = [(d, t) for d, t in corpus(awkward) if t is None or len(t) < 9000]
    got = rows_of(suffix_dedup.suffix_dedup(table(spark, rows), length))
    # rows that are one document twice: either may be listed, both alike
    assert got == brute_bytes(rows, length)


def test_suffix_dedup_in_pieces(spark, awkward, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr(suffix_dedup, "HELD", 4000)
    rows = [(d, t) for d, t in corpus(awkward)[:60] if t is None or len(t) < 9000]
    assert rows_of(suffix_dedup.suffix_dedup(table(spark, rows))) == brute_bytes(rows, 100)


@pytest.mark.parametrize("prefix", [b"", b"x" * 60])
def test_loser_tree_merge_never_reads_known_prefixes(monkeypatch, prefix):
    """The merge gives sorted suffixes and their common prefixes; comparisons begin at the known prefix, so all of them together
    read no more than the bytes that front coding left, and one for each comparison."""
    import numpy as np

    r, n, asked = random.Random(3), len(prefix) + 40, []
    plain = suffix_dedup.differ_at

    def told(x, y, at):
        asked.append((x[:at], y[:at]))
        return plain(x, y, at)

    monkeypatch.setattr(suffix_dedup, "differ_at", told)
    for runs in (1, 2, 3, 7, 16):
        asked.clear()
        entries = [[(prefix + bytes(r.choice(b"ab\0") for _ in range(r.randrange(1, 40))), b"", i, 0, j) for j in range(r.randrange(1, 60))] for i in range(runs)]
        coded = [suffix_dedup.unpacked(suffix_dedup.front_coded(e, n)) for e in entries]
        order, lcp, read = suffix_dedup.merged([(c[0], c[1]) for c in coded], n)
        flat = [e[0].ljust(n, b"\0") for own in entries for e in own]
        out = [flat[i] for i in order]
        assert out == sorted(flat)
        for a, b, h in zip(out, out[1:], lcp[1:].tolist(), strict=False):
            assert h == next((i for i in range(n) if a[i] != b[i]), n)
        assert len(np.unique(order)) == len(flat)
        assert all(x == y for x, y in asked)  # what isn't read is known to be common
        assert read <= sum(len(c[1]) for c in coded) + len(asked)
        assert runs == 1 or not prefix or read < 0.7 * n * len(asked)


def test_fm_index_counts():
    import numpy as np

    r = np.random.default_rng(1)
    text = np.concatenate([r.integers(1, 6, 300), [0], np.tile(r.integers(1, 6, 40), 5), [0], r.integers(1, 6, 200), [0]])
    ids = r.integers(0, 50, len(text))
    index = substring_dedup.FMIndex(text, 6, 5, ids)
    ends = np.arange(len(text))[text > 0]
    length, lo, hi = index.matching_statistics(text, ends, 5, 2)
    s = text.tolist()
    places = lambda e, k: [i for i in range(len(s) - k + 1) if s[i : i + k] == s[e - k + 1 : e + 1]]
    for e, n, a, b in zip(ends.tolist(), length.tolist(), lo.tolist(), hi.tolist(), strict=True):
        assert n == max((k for k in range(1, 6) if k <= e + 1 and 0 not in s[e - k + 1 : e + 1] and len(places(e, k)) > 1), default=0)
        assert n == 0 or b - a == len(places(e, n))
        assert n < 5 or index.least_of(np.array([a])).tolist() == [min(ids[i] for i in places(e, 5))]


def test_fm_index_is_compressed():
    """Repeated text takes less than a bit array would, and no place of the suffix order."""
    import numpy as np

    r = np.random.default_rng(2)
    once = r.integers(1, 2000, 500)
    text = np.concatenate([np.append(once if k % 10 else r.integers(1, 2000, 500), 0) for k in range(200)])
    index = substring_dedup.FMIndex(text, 14, 13, np.zeros(len(text), np.int64))
    plain = sum(12 * (len(text) // 64 + 1) for _ in index.levels)
    assert sum(b.nbytes for _, b, _ in index.levels) < 0.65 * plain and index.nbytes < 2 * len(text) + 2000 * 16
    bits = r.random(5000) < np.repeat([0.0, 1.0, 0.5, 0.0, 1.0], 1000)
    ranks = substring_dedup.Bits(bits)
    assert ranks.rank(np.arange(5001)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()


def brute_components(rows, n, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(low).encode().split()
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 1 << 63), 1 << 63 if d is None else d)
    return sorted(((d, len(sets[i]), None if least[top(i)] == 1 << 63 else least[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_ngram_components(spark, awkward, n, num, den):
    rows = corpus(awkward)
    assert rows_of(jaccard_join.ngram_components(table(spark, rows), n, num, den)) == brute_components(rows, n, num, den)


def test_large_components_are_answered_by_their_leaders(spark, monkeypatch):
    """Two components that share blocks but don't link, and a third that links with the first by its leaders: few sets are compared."""
    r, common, n = random.Random(6), prose(60, 150).split(), 400
    third = prose(63, 190).split()
    rare = prose(65, 10).split()
    bases = [common + prose(61, 25).split(), common + prose(62, 25).split(), third, third[:172] + prose(64, 17).split()]
    texts = []
    for base in bases:
        texts.append(" ".join(base))
        for i in range(n):
            w = list(base)
            w[r.randrange(len(w))] = f"edit{len(texts)}"
            if i % 4 == 0:  # rarer than the rest: a shared passage that stands first in the lists of both
                w[60:60] = rare
            texts.append(" ".join(w))
    compared, overlaps = [], jaccard_join.Join.overlaps

    def counted(self, pairs, sets):
        found = overlaps(self, pairs, sets)
        compared.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join.Join, "overlaps", counted)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.ngram_components(table(spark, texts)).collect()}
    assert [{got[i] for i in range(k * (n + 1), (k + 1) * (n + 1))} for k in range(4)] == [{0}, {n + 1}, {2 * n + 2}, {2 * n + 2}]
    assert compared[1] > 0 and sum(compared) < 5 * len(texts), compared


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(3, 3)], "a long, b long")
    assert {(r["node"], r["label"]) for r in jaccard_join.components(edges).collect()} == {(i, i - i % 10) for i in range(40)}


def test_one_of_each_and_without_repeats(spark, awkward):
    rows = [(d, t) for d, t in dict(corpus(awkward)).items() if d is not None]
    docs = table(spark, rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute_components(rows, 5, 4, 5) if c == d or not (dict(rows)[d] or "").split()}
    assert {r["doc_id"] for r in kept.collect()} == want
    clean = substring_dedup.without_repeats(docs, 50)
    assert clean.columns == docs.columns
    words = {r["doc_id"]: r for r in clean.collect()}
    for d, n, removed, sha in brute_words(rows, 50):
        text = words[d]["text"]
        assert text == dict(rows)[d] if not removed else hashlib.sha256(text.encode()).hexdigest() == sha
        assert text is None or words[d]["n_chars"] == len(text)
        assert words[d]["_k"] == "x" and n >= removed


def test_one_of_each_leaves_one_row_of_a_group(spark):
    """Null ids, repeated rows and near copies under one id; what only shares an id stays."""
    copy, other, third = prose(50, 200), prose(51, 200), prose(52, 200)
    near = [" ".join([*copy.split()[:-1], f"end{i}"]) for i in range(3)]
    nulls = [" ".join([*other.split()[:-1], f"end{i}"]) for i in range(3)]
    rows = [(7, copy), (7, copy), (7, copy), *[(7, t) for t in near], (9, copy), *[(None, t) for t in nulls], (None, other), (None, other), (7, third), (None, ""), (None, "")]
    got = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(table(spark, rows)).collect()]
    groups = [copy, *near], [other, *nulls], [third], [""]
    assert [[d for d, t in got if t in g] for g in groups] == [[7], [None], [7], [None, None]]


def test_empty(spark):
    none = table(spark, [])
    assert suffix_dedup.suffix_dedup(none).count() == substring_dedup.substring_dedup(none).count() == 0
    assert jaccard_join.ngram_components(none).count() == jaccard_join.one_of_each(none).count() == substring_dedup.without_repeats(none).count() == 0
