"""Folders: direct sums, roll-up to all ancestors, children, and the tiles of one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasearch.functions import paths

TILES = 256


def placed(files: DataFrame) -> DataFrame:
    """Adds _path (normalized) and _parent."""
    return files.withColumn("_path", paths.normalize("path")).withColumn("_parent", paths.parent_of(F.col("_path")))


def direct(files: DataFrame) -> DataFrame:
    """(folder, bytes, count) of the files right in each folder; an empty file weighs 1."""
    rows = placed(files.filter("kind <> 'Dir'").select("path", "size"))
    return rows.groupBy(F.col("_parent").alias("folder")).agg(F.sum(F.greatest("size", F.lit(1))).alias("bytes"), F.count(F.lit(1)).alias("count"))


def folders(files: DataFrame) -> DataFrame:
    """Every folder there is: ancestors of all rows, and directory rows; always /."""
    rows = placed(files.select("path", "kind"))
    up = rows.select(F.col("_parent").alias("p")).distinct().select(F.explode(paths.ancestors_of(F.col("p"))).alias("folder"))
    own = rows.filter("kind = 'Dir'").select(F.col("_path").alias("folder"))
    return up.unionByName(own).unionByName(files.sparkSession.range(1).select(F.lit("/").alias("folder"))).distinct()


def rollup(files: DataFrame) -> DataFrame:
    """(folder, bytes, count) over everything below each folder. Files are summed by parent first, so folders, not files, are
    exploded into ancestors."""
    sums = direct(files).select(F.explode(paths.ancestors_of(F.col("folder"))).alias("folder"), "bytes", "count")
    none = folders(files).select("folder", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("count"))
    return sums.unionByName(none).groupBy("folder").agg(F.sum("bytes").alias("bytes"), F.sum("count").alias("count"))


def children(files: DataFrame) -> DataFrame:
    """(parent, child), distinct: each step of the ancestor lists, and each directory row below its parent (/ is its own child
    if there is a row for it)."""
    rows = placed(files.select("path", "kind"))
    lists = rows.select(F.col("_parent").alias("p")).distinct().select(paths.ancestors_of(F.col("p")).alias("a"))
    steps = lists.select(F.explode(F.arrays_zip(F.expr("slice(a, 1, size(a) - 1)").alias("parent"), F.expr("slice(a, 2, size(a))").alias("child"))).alias("s")).filter("s.parent is not null and s.child is not null").select("s.parent", "s.child")
    own = rows.filter("kind = 'Dir'").select(F.col("_parent").alias("parent"), F.col("_path").alias("child"))
    return steps.unionByName(own).distinct()


def step_below(folder: str, parent: Column) -> Column:
    """The folder right below ``folder`` on the way to ``parent`` (normalized); null if the way doesn't lead there. As ancestors_of has it."""
    drive, share = r"^[A-Za-z]:/", r"^//[^/]+/[^/]+"
    p = F.when(parent.startswith("/") | parent.rlike(drive), parent).otherwise(F.concat(F.lit("/"), parent))
    if folder == "/":
        first = F.concat(F.lit("/"), F.substring_index(F.substring(p, 2, 1 << 30), "/", 1))
        return F.when(p.rlike(drive), F.substring(p, 1, 3)).when(p.startswith("//"), F.nullif(F.regexp_extract(p, share, 0), F.lit(""))).when(p != "/", first)
    start = folder if folder.endswith("/") else folder + "/"
    return F.when(p.startswith(start) & (p != start), F.concat(F.lit(start), F.substring_index(F.substring(p, len(start) + 1, 1 << 30), "/", 1)))


def tiles(files: DataFrame, folder: str, most: int = TILES) -> DataFrame:
    """Child folders and direct files of one folder by bytes, the largest first; path settles ties.

    An extension here is all after the last dot of the name, in lower case.
    """
    rows = placed(files.select("path", "kind", "size"))
    is_dir = F.col("kind") == "Dir"
    # one row a parent first, so that folders, not files, look for their way down; directory rows name their own
    sums = rows.filter(~is_dir).groupBy("_parent").agg(F.sum(F.greatest("size", F.lit(1))).alias("bytes"), F.count(F.lit(1)).alias("count")).withColumn("_path", F.lit(None).cast("string"))
    none = rows.filter(is_dir).select("_parent", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("count"), "_path")
    child = step_below(folder, F.col("_parent"))
    found = sums.unionByName(none).withColumn("path", F.when(F.col("_parent") == folder, F.col("_path")).otherwise(child))
    if folder == "/":  # / is its own child if there is a row for it, and all is below it
        found = found.withColumn("path", F.explode(F.array("path", F.lit("/"))))
    found = found.filter("path is not null").groupBy("path").agg(F.sum("bytes").alias("bytes"), F.sum("count").alias("count"), F.max(F.coalesce(F.col("_path") == "/", F.lit(False))).alias("_root"))
    dirs = found.filter((F.col("path") != "/") | F.col("_root")).select(
        "path", paths.display_name("path").alias("name"), F.greatest("bytes", F.lit(1)).alias("bytes"), "count", F.lit(True).alias("folder"), F.lit("").alias("extension"))
    name = paths.display_name("path")
    direct_ = placed(files.filter("kind <> 'Dir'")).filter(F.col("_parent") == folder).select(
        "path", name.alias("name"), F.greatest("size", F.lit(1)).alias("bytes"), F.lit(1).cast("long").alias("count"), F.lit(False).alias("folder"),
        paths.ascii_lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))).alias("extension"))
    return dirs.unionByName(direct_).orderBy(F.desc("bytes"), "path", "folder").limit(most)


def layout(weights: list[int], x: float, y: float, width: float, height: float) -> list[tuple[int, float, float, float, float]]:
    """(tile, x, y, width, height) on the driver, for the few tiles of one view: halve by weight, cut the longer side."""
    found, open_ = [], [(0, len(weights), x, y, width, height)]
    while open_:
        a, b, x, y, w, h = open_.pop()
        if a == b or w < 2 or h < 2:
            continue
        if b - a == 1:
            found.append((a, x, y, w, h))
            continue
        total, left, cut = max(1, sum(weights[a:b])), 0, a
        while cut < b - 1 and (cut == a or left < total // 2):
            left += weights[cut]
            cut += 1
        share = min(0.92, max(0.08, left / total))
        if w >= h:
            open_ += [(cut, b, x + w * share, y, w * (1 - share), h), (a, cut, x, y, w * share, h)]
        else:
            open_ += [(cut, b, x, y + h * share, w, h * (1 - share)), (a, cut, x, y, w, h * share)]
    return found
