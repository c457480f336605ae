"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs once to warm up, then the median of three counts."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from dataclasses import replace
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from metasearch import registry  # noqa: E402
from metasearch.operators import search  # noqa: E402
from metasearch.plans.query import Query, Sort, parse  # noqa: E402
from metasearch.sources.generate import synthetic  # noqa: E402
from metasearch.store import Reader  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NEEDLE_ROWS = 1_000_000
HEADLINES = [
    "search_flagship", "search_multi_term", "search_unlimited", "filter_size_min", "filter_under", "sort_mtime", "post_filter_regex", "search_trigram_pruned", "delta_fold", "overlay_search",
    "folder_rollup", "treemap_root", "namespace_sequence_check", "namespace_hardlinks", "response_json", "store_roundtrip", "store_compaction", "stream_apply",
]


def timed(run) -> float:  # noqa: ANN001
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    work = {name: (lambda f=registry.QUERIES[name]: sink(f(spark, SF))) for name in HEADLINES}
    table = synthetic(spark, NEEDLE_ROWS).repartition(int(CPUS)).cache()
    table.count()
    needle = replace(parse(f"needle{NEEDLE_ROWS - 1:08x}"), limit=1000)
    work["needle_1m_cached"] = lambda: sink(search.ranked(search.matches(table, needle), needle))
    by_size = Query(exts=("rs", "png"), min_size=1 << 19, sort=Sort.SIZE, limit=100)
    work["filter_sort_1m_cached"] = lambda: sink(search.ranked(search.matches(table, by_size), by_size))
    # the same rows in a store: by its index, and by a scan
    reader = Reader(registry.new_store(spark))
    reader.store.build(table)
    work["stored_needle_indexed"] = lambda: sink(search.ranked(search.matches(reader.rows(needle), needle), needle))
    work["stored_needle_scanned"] = lambda: sink(search.ranked(search.matches(reader.files(), needle), needle))
    try:
        from metasearch.llm import queries as llm
    except ImportError:
        pass
    else:
        work |= {name: (lambda f=f: sink(f(spark, SF))) for name, f in llm.queries().items()}
    found = {}
    for name, run in work.items():
        first = timed(run)
        again = 3 if first < 5 else 1
        found[name] = round(statistics.median(timed(run) for _ in range(again)), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": SF}))


if __name__ == "__main__":
    main()
