"""Exact Jaccard join of word n-gram sets, as components: index lists skipped by position, answers derived from similar sets.

A document's set holds the hashes (64 bits) of its n-word shingles. Equal sets are one class from the start. Shingles are ordered by
document frequency, so a set starts with what it shares with the fewest others, and two sets that reach the threshold share a shingle in
their prefixes. Three things keep the lists short:

* Unshared shingles come first and are never listed. A set whose unshared shingles alone fill its prefix can link with nothing;
  most documents end there, told by bits for a fixed part of the hash range (shared.py), without a row a shingle.
* An index list is kept as blocks of (set size, position): the bound on the overlap is the same for a whole block, so one comparison
  skips it, and blocks are opened only if they pass.
* Links found first (each set with the set that leads most of its lists, its leader) give components; sets of one component need no comparison with each
  other, whatever the group's size. Only pairs between components are opened.
* Members' answers are derived from those of their leaders: two sets share at most what their leaders share and what each has beyond its leader. Leaders
  of open blocks are compared once; their overlap answers whole blocks of members with one number each (the most that a member of
  the block has beyond the leader; unshared shingles don't count). Only members that the bound leaves are compared themselves, and none between components that their leaders link.

No link is lost: every pair that reaches the threshold is verified or already within one component. Sets are told apart by 128 bits of a hash, shingles by 64.

Defined results: words lie between spaces, tabs and line ends, with A-Z lower-cased; fewer words than n make one shingle; a null or wordless text has an
empty set and links with nothing; a null id counts as larger than all others; repeated rows are each returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasearch.llm import shared
from metasearch.llm.base import U64, WordHashes, cut, gram_hashes, in_batches, keyed, rows_of, utf8


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else np.empty(0, U64)


def plain_words(text: str | None) -> list[bytes]:
    """What lies between spaces, tabs and line ends, with A-Z lower-cased."""
    return utf8(text).lower().split()


def upper(a: Column, num: int, den: int) -> Column:
    """The ceiling of a * num / den."""
    return F.floor((a * num + (den - 1)) / den).cast("long")


def required(a: Column, b: Column, num: int, den: int) -> Column:
    """Least overlap of sets of sizes a and b with a Jaccard similarity of num / den."""
    return upper(a + b, num, num + den)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is its component's smallest node. Alternating large and small stars."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        sum_ = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == sum_ or sum_["n"] == 0:
            break
        state = sum_
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


class Join:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int, words: Callable[[str | None], list[bytes]] = plain_words) -> None:
        self.docs, self.n, self.num, self.den, self.words = docs, n, num, den, words
        # the part of the hash range must hold well over (1 - threshold) of a set
        self.skip = 0
        while 2 * 10 * den >= 48 * (den - num) * (1 << self.skip + 1) and self.skip < 4:
            self.skip += 1

    def prefix(self, size: Column) -> Column:
        return size - upper(size, self.num, self.den) + 1

    def sized(self) -> DataFrame:
        """doc_id, _k, digest (class: 16 bytes of a hash of the set), n, single (unshared shingles seen) for every row."""
        n, skip, words = self.n, (1 << self.skip) - 1, self.words

        def describe():  # noqa: ANN202
            memo = WordHashes()

            def of(text: str | None) -> tuple[np.ndarray, bytes]:
                s = shingle_set(memo.of(words(text)), n)
                return s[(s & U64(skip)) == 0], len(s).to_bytes(8, "big") + hashlib.blake2b(s.tobytes(), digest_size=16).digest()

            return of

        rows = shared.shared_keys(self.docs, describe, only_shared=False)
        return cut(rows.select(
            "doc_id", "_k", F.substring("extra", 9, 16).alias("digest"),
            F.conv(F.hex(F.substring("extra", 1, 8)), 16, 10).cast("long").alias("n"), (F.col("n_keys") - F.col("n_shared")).alias("single")))

    def sets(self, classes: DataFrame) -> DataFrame:
        """(node, n, tokens) of the classes' representatives."""
        n, words = self.n, self.words
        schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                memo = WordHashes()
                for node, text in rows_of(batches, "node", "text"):
                    s = shingle_set(memo.of(words(text)), n)
                    yield node, len(s), s.view(np.int64)

            yield from in_batches(rows(), schema, 256)

        maybe, _ = shared.split_by(self.docs.select("doc_id", "_k", "text"), classes)
        return cut(shared.with_rows(maybe, classes).dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node bigint, n bigint, tokens array<bigint>"))

    def listed(self, sets: DataFrame) -> DataFrame:
        """(token, node, n, alone, at): the shared shingles of each set's prefix and their positions, by frequency, then hash; alone: how many are unshared."""
        tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
        # written first: Spark splits a skewed join only if plain tables meet in it
        often = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
        lists = tokens.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x"))
        alone = F.col("n") - F.size("x")
        lists = lists.withColumn("alone", alone).withColumn("take", (self.prefix(F.col("n")) - alone).cast("int")).filter("take > 0")
        return cut(lists.select("node", "n", "alone", F.posexplode(F.expr("slice(x, 1, take)"))).select(F.col("col.token").alias("token"), "node", "n", "alone", (F.col("alone") + F.col("pos")).alias("at")))

    def passes(self, n: str, at: str, n2: str, at2: str) -> Column:
        """The sizes fit, and what follows the positions is enough for the threshold."""
        big, small = F.greatest(n, n2), F.least(n, n2)
        return (small * self.den >= big * self.num) & (F.least(F.col(n) - F.col(at), F.col(n2) - F.col(at2)) >= required(F.col(n), F.col(n2), self.num, self.den))

    def overlaps(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with na, nb and both: the sizes and the overlap of their sets."""
        first = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
        second = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
        # merged, not hashed: a leader that many sets have is a skewed key, which Spark splits in merge joins
        return cut(pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("both")))

    def linked(self, overlaps: DataFrame) -> DataFrame:
        """Those that reach the threshold."""
        return overlaps.filter(F.col("both") * self.den >= (F.col("na") + F.col("nb") - F.col("both")) * self.num)

    def led(self, lists: DataFrame, found: DataFrame) -> DataFrame:
        """``lists`` with group (component), leader and far (how many shared shingles of the set its leader lacks, at most): the
        nearer of the one it was linked with and that one's."""
        label = components(found.select("a", "b"))
        step = found.join(lists.select(F.col("node").alias("a"), "n", "alone").distinct(), "a").select("a", "b", (F.col("n") - F.col("alone") - F.col("both")).alias("far"))
        next_ = step.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("far").alias("more"))
        leaders = step.join(next_, "b", "left").select(F.col("a").alias("node"), F.least(
            F.struct(F.col("far"), F.col("b").alias("leader")), F.when(F.col("c") != F.col("a"), F.struct((F.col("far") + F.col("more")).alias("far"), F.col("c").alias("leader")))).alias("l"))
        known = cut(label.join(leaders, "node", "left"))
        return cut(lists.join(known, "node", "left").select(
            "token", "node", "n", "at", F.coalesce("label", "node").alias("group"), F.coalesce("l.leader", "node").alias("leader"), F.coalesce("l.far", F.lit(0)).alias("far")))

    def links(self, sets: DataFrame) -> DataFrame:
        """Edges between classes that connect all sets which links connect."""
        lists = self.listed(sets)
        # first the set that leads a list: the one with the fewest rare shingles
        lead = lists.groupBy("token").agg(F.min(F.struct("at", "node", "n")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        near = lists.join(cut(lead).select("token", F.col("p.node").alias("b"), F.col("p.n").alias("n2"), F.col("p.at").alias("at2")), "token")
        near = near.filter(F.col("node") != F.col("b")).filter(self.passes("n", "at", "n2", "at2")).groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"))
        found = self.linked(self.overlaps(near.groupBy("a").agg(F.max(F.struct("c", "b")).alias("x")).select("a", F.col("x.b").alias("b")), sets))
        # then all pairs between components: blocks of members of one leader
        placed = self.led(lists, found)
        key = ["token", "group", "leader", "n", "at"]
        blocks = placed.groupBy(*key).agg(F.max("far").alias("far"))
        index = blocks.filter(F.col("at") <= F.col("n") - required(F.col("n"), F.col("n"), self.num, self.den)).select("token", *[F.col(c).alias(f"{c}2") for c in ("group", "leader", "n", "at", "far")])
        least = required(F.col("n"), F.col("n2"), self.num, self.den)
        open_ = blocks.join(index, "token").filter("group <> group2 and n2 <= n").filter(self.passes("n", "at", "n2", "at2"))
        ends = {"a": F.least("leader", "leader2"), "b": F.greatest("leader", "leader2"), "g": F.least("group", "group2"), "h": F.greatest("group", "group2")}
        open_ = cut(open_.withColumns(ends))
        # one row a pair of leaders, so that however many blocks two groups share, they meet as one
        leaders = cut(open_.select(*ends).distinct())
        known = self.overlaps(leaders.select("a", "b"), sets)
        first = self.linked(known).select("a", "b")
        done = leaders.join(first, ["a", "b"]).select("g", "h").distinct()
        asked = leaders.join(done, ["g", "h"], "left_anti").join(known, ["a", "b"]).select("a", "b", "both")
        left_open = cut(open_.join(asked, ["a", "b"]).filter(F.col("both") + F.col("far") + F.col("far2") >= least).select(*key, "group2", "leader2", "n2", "at2", "both"))
        left = placed.select(*key, F.col("node").alias("a"), F.col("far"))
        right = placed.select("token", *[F.col(c).alias(f"{c}2") for c in ("group", "leader", "n", "at", "far")], F.col("node").alias("b"))
        pairs = left_open.join(left, key).join(right, ["token", "group2", "leader2", "n2", "at2"]).filter(F.col("both") + F.col("far") + F.col("far2") >= least)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return found.select("a", "b").unionByName(first).unionByName(self.linked(self.overlaps(pairs, sets)).select("a", "b"))

    def labelled(self) -> tuple[DataFrame, DataFrame]:
        """Every row as sized() has it; and (digest, r, label): each class, its smallest row and its component."""
        sized = self.sized()
        classes = sized.filter("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k")).alias("r"), F.first("n").alias("n"), F.min("single").alias("single"))
        # classes that may link get numbers of their own: written at once, so each has one
        open_ = cut(classes.filter(F.col("single") < self.prefix(F.col("n"))).select(F.monotonically_increasing_id().alias("node"), "digest", "r.doc_id", "r._k"))
        label = components(self.links(self.sets(open_.drop("digest")))).withColumnRenamed("label", "component")
        of = open_.select("node", "digest").join(label, "node", "left").select("digest", F.coalesce("component", "node").cast("string").cast("binary").alias("label"))
        # a class that can't link is a component by itself, named by its digest (longer than any number)
        return sized, classes.select("digest", "r").join(of, "digest", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("digest").cast("binary"), "digest")))

    def run(self) -> DataFrame:
        sized, known = self.labelled()
        known = known.select("digest", "r.doc_id", "label")
        smallest = cut(known.groupBy("label").agg(F.min("doc_id").alias("component_id")))
        of = known.select("digest", "label").join(smallest, "label").select("digest", "component_id")
        rows = sized.join(of, "digest", "left")
        return rows.select("doc_id", "_k", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, words: Callable[[str | None], list[bytes]] = plain_words) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; sets link from a Jaccard similarity of num / den on. ``words``: how a text is split."""
    return Join(keyed(docs), n, num, den, words).run().drop("_k")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, words: Callable[[str | None], list[bytes]] = plain_words) -> DataFrame:
    """``docs`` with all columns, one row of each component: of the smallest (id, text hash), and the smallest of that one's repeats.

    Rows without words have no component and all stay.
    """
    rows = keyed(docs, F.struct("*").alias("_row")).drop("text")
    sized, known = Join(keyed(docs), n, num, den, words).labelled()
    first = cut(known.groupBy("label").agg(F.min("r").alias("first")))
    of = known.select("digest", "label").join(first, "label").select("digest", "first")
    # a row for each (id, text): repeats are counted before they meet the others
    each = sized.filter("n > 0").groupBy("digest", "doc_id", "_k").agg(F.count(F.lit(1)).alias("c"))
    each = each.join(of, "digest").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_k") == F.col("first._k")))
    touched = cut(each.filter("not stays or c > 1").select("doc_id", "_k", "stays"))
    maybe, rest = shared.split_by(rows, touched)
    maybe = shared.with_rows(maybe, touched, "left")
    # the smallest of the repeats, by partial aggregation
    again = maybe.filter("stays").groupBy("doc_id", "_k").agg(F.min("_row").alias("_row"))
    return maybe.filter("stays is null").select("_row").unionByName(rest.select("_row")).unionByName(again.select("_row")).select("_row.*")
