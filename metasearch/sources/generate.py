"""Made tables for tests and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasearch.schema import as_files

EXTENSIONS = ["rs", "toml", "txt", "md", "json", "png", "log"]
#: Names in several scripts, for the demo table.
NAMES = ["invoice-2024.pdf", "budget.xlsx", "notes.md", "photo.JPG", "archive.tar.gz", "报告.txt", "تقرير.pdf", "रिपोर्ट.doc", "main.rs", ".gitignore", "README", "movie.mkv", "song..mp3", "a b.csv", "x.iso", "trailing.", "data.json"]


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """n files with hashed names below a few thousand folders; the last one is needle{n - 1 as 08x}."""
    i = F.col("id")
    name = F.when(i == n - 1, F.format_string("needle%08x", i)).otherwise(F.format_string("item-%016x", F.xxhash64("id")))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.pmod(i, F.lit(len(EXTENSIONS))) + 1).cast("int"))
    path = F.concat(F.format_string("/data/%02x/%02x/", F.pmod(F.xxhash64(F.lit("a"), "id"), F.lit(256)), F.pmod(F.xxhash64(F.lit("b"), "id"), F.lit(16))), name, F.lit("."), ext)
    rows = spark.range(n).select(path.alias("path"), F.pmod(F.xxhash64(F.lit("s"), "id"), F.lit(1 << 20)).alias("size"), (F.lit(1_700_000_000) + i).alias("mtime"), F.lit(0o100644).cast("long").alias("mode"), i.alias("native_id"))
    return as_files(rows)


def demo(spark: SparkSession) -> DataFrame:
    """A literal table: named files of many kinds, and a run of generated ones."""
    rows = [(f"/home/user/{n}", 1000 * (i + 1), 1_700_000_000 + i) for i, n in enumerate(NAMES)]
    rows += [(f"/home/user/generated/file-{i:02d}.{EXTENSIONS[i % len(EXTENSIONS)]}", 37 * i, 1_690_000_000 + i) for i in range(48)]
    return as_files(spark.createDataFrame(rows, "path string, size long, mtime long"))
