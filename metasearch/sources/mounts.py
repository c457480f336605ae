"""Choosing mounts and filtering what a scan returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metasearch.functions import labels, paths
from metasearch.plans.compile import some
from metasearch.plans.query import absolute

MAX_MOUNTS = 32
#: Readers (in native.LANES) by label. Other labels can't be scanned here.
LANES = {"btrfs": "btrfs_files", "ext4": "ext_files", "ntfs": "ntfs_files"}


def lane(label: str) -> str:
    """The reader of a filesystem; network, snapshot-only and unknown filesystems are errors, never walked."""
    if label == "zfs":
        raise NotImplementedError("zfs has no scan; use its diff")
    if label not in LANES:
        raise ValueError(f"no reader for {label!r}")
    return LANES[label]


def contains(mountpoint: Column, path: Column) -> Column:
    """By components."""
    m = F.regexp_replace(mountpoint, r"/+\z", "")
    return (path == mountpoint) | (path == m) | F.startswith(path, F.concat(m, F.lit("/")))


def mounts_for_roots(roots: DataFrame, mounts: DataFrame) -> DataFrame:
    """(root, mountpoint, fs): the longest mount that contains each root, if a local scan can read it.

    Each root looks up its own ancestors, so the join is on equality.
    """
    ways = roots.select("root", F.explode(paths.ancestors("root")).alias("_way")).distinct()
    pairs = ways.join(mounts.select("mountpoint", "fs", paths.normalize("mountpoint").alias("_way")), "_way")
    longest = Window.partitionBy("root").orderBy(F.desc(F.octet_length("mountpoint")), F.desc("mountpoint"))
    return pairs.withColumn("_n", F.row_number().over(longest)).filter((F.col("_n") == 1) & labels.is_local(F.col("fs"))).select("root", "mountpoint", "fs")


def resolve(requested: DataFrame, trusted: DataFrame) -> DataFrame:
    """Trusted rows for the requested mountpoints, each once; an unknown one is an error."""
    names = requested.select("mountpoint").distinct()
    if requested.limit(MAX_MOUNTS + 1).count() > MAX_MOUNTS:
        raise ValueError(f"more than {MAX_MOUNTS} mounts")
    unknown = names.join(trusted.select("mountpoint"), "mountpoint", "left_anti").head(1)
    if unknown:
        raise ValueError(f"{unknown[0][0]} is not in the mount table")
    return trusted.join(names, "mountpoint", "left_semi").dropDuplicates(["mountpoint"])


def new_network_mounts(mounts: DataFrame, seen: DataFrame) -> DataFrame:
    """Network mounts whose device:mountpoint isn't among ``seen`` (identity)."""
    rows = mounts.filter("source_kind = 'Remote'").withColumn("identity", F.concat_ws(":", "device", "mountpoint"))
    return rows.join(seen.select("identity"), "identity", "left_anti").dropDuplicates(["identity"])


def excluded(path: Column | str, mountpoint: str) -> Column:
    """Snapshots of the mount, and what the kernel shows below / ."""
    below = lambda root: (paths.col(path) == root) | F.startswith(paths.col(path), F.lit(root + "/"))
    base = mountpoint.rstrip("/")
    found = below(f"{base}/.snapshots")
    return found | below("/proc") | below("/sys") if not base else found


def scanned(files: DataFrame, mountpoint: str, roots: list[str]) -> DataFrame:
    """Rows of a scan that stay: not excluded, and inside an approved root (none without roots)."""
    return files.filter(~excluded("path", mountpoint) & (some([paths.in_root("path", r) for r in roots]) if roots else F.lit(False)))


def looked_up(mounts: DataFrame, mountpoint: str) -> DataFrame:
    """The mount table's rows of one mountpoint, however it is written."""
    return mounts.filter(paths.normalize("mountpoint") == paths.normalize(F.lit(mountpoint)))


#: Roots that stand in the plan as prefixes; more meet the paths in a join.
FEW_ROOTS = 256


def scanned_by(files: DataFrame, roots: DataFrame, few: int = FEW_ROOTS) -> DataFrame:
    """The same for a table of roots of any length. Up to ``few`` distinct roots stand in the plan as prefixes: one narrow pass. More meet
    the paths' ancestors by equality."""
    some_ = [r["root"] for r in roots.select(paths.normalize("root").alias("root")).distinct().limit(few + 1).collect()]
    if len(some_) <= few:
        path = paths.normalize("path")
        return files.filter(some([F.lit(True) if r == "/" else (path == r) | path.startswith(r.rstrip("/") + "/") for r in some_]) if some_ else F.lit(False))
    ways = files.select("path", F.explode(paths.ancestors("path")).alias("_way"))
    inside = ways.join(roots.select(paths.normalize("root").alias("_way")).distinct(), "_way", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_semi").select(*files.columns)


def validate_roots(roots: list[str], mountpoints: list[str]) -> list[str]:
    """Approved roots without repeats: absolute, normalized, inside a requested mount."""
    if len(roots) > MAX_MOUNTS:
        raise ValueError(f"more than {MAX_MOUNTS} roots")
    if not roots and not mountpoints:
        return []
    if not roots:
        raise ValueError("a scan needs a root")
    plain = lambda p: p.replace("\\", "/").rstrip("/")
    kept: list[str] = []
    for root in roots:
        if not absolute(root) or "\0" in root or any(c in (".", "..") for c in root.replace("\\", "/").split("/")):
            raise ValueError("roots must be absolute and normalized")
        if not any(plain(root) == plain(m) or (plain(root) + "/").startswith(plain(m) + "/") for m in mountpoints):
            raise ValueError(f"{root} is outside the requested mounts")
        if plain(root) not in map(plain, kept):
            kept.append(root)
    return kept


def watch_excluded(path: Column | str, mountpoint: str, own_files: list[str]) -> Column:
    """Outside the mount, or one of the catalog's own files."""
    return ~contains(F.lit(mountpoint), paths.col(path)) | paths.col(path).isin(own_files)
