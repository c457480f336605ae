import zlib
from collections import Counter

from metasearch.llm import sharding
from tests.llm.conftest import table


def jump(key, n):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < n:
        b, key = j, key * sharding.MULTIPLIER + 1 & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark, awkward):
    rows = [(i * 7919 - 50, t) for i, t in enumerate(awkward * 20)] + [(None, "a"), (5, "same"), (5, "same"), (5, None)]
    got = sharding.shard_table(table(spark, rows), 40).collect()
    assert len(got) == len(rows)
    for r in got:
        key = r["doc_id"] or 0
        assert (r["shard"], r["grown_shard"], r["law"]) == (jump(key, 40), jump(key, 41), "key")
        assert r["grown_shard"] in (r["shard"], 40)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_spread_and_extremes(spark):
    rows = spark.range(40_000).selectExpr("id as doc_id", "'t' as text")
    sizes = [r["n"] for r in sharding.shard_table(rows).groupBy("shard").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 40 and max(sizes) < 1.2 * min(sizes)
    big = spark.createDataFrame([((1 << 63) - 1, "a"), (-(1 << 63), "b")], "doc_id long, text string")
    assert {r["doc_id"]: r["shard"] for r in sharding.shard_table(big).collect()} == {k: jump(k, 40) for k in ((1 << 63) - 1, -(1 << 63))}


def test_empty(spark):
    assert sharding.shard_table(table(spark, [])).count() == 0
