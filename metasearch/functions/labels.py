"""Labels and formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metasearch.functions import paths

#: Filesystem names and the label each belongs to.
FILESYSTEMS = {
    "btrfs": "btrfs",
    "ext2": "ext4", "ext3": "ext4", "ext4": "ext4",
    "ntfs": "ntfs", "ntfs3": "ntfs", "ntfs-3g": "ntfs", "fuseblk": "ntfs",
    "zfs": "zfs",
}
#: Network filesystems; their label is net: and the name.
NETWORK = ["nfs", "nfs4", "cifs", "smb3", "smbfs", "sshfs", "fuse.sshfs", "9p", "virtiofs", "glusterfs", "ceph", "fuse.ceph"]
#: Labels that a local scan can read.
LOCAL = ["btrfs", "ext4", "ntfs", "zfs"]
#: Extensions by category.
CATEGORIES = {
    "pdf": ["pdf"],
    "spreadsheet": ["xls", "xlsx", "ods", "csv"],
    "document": ["doc", "docx", "txt", "md", "rtf"],
    "archive": ["zip", "7z", "rar", "tar", "gz", "pak", "iso"],
    "media": ["png", "jpg", "jpeg", "gif", "webp", "svg", "mp4", "mkv"],
}
#: The file type part of Unix mode bits.
TYPE_BITS, REGULAR, DIRECTORY, LINK = 0o170000, 0o100000, 0o040000, 0o120000


def fs_label(name: str) -> str:
    """The label of a filesystem name; unknown names are their own label."""
    return FILESYSTEMS.get(name) or (f"net:{name}" if name in NETWORK else name)


def fs_label_of(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FILESYSTEMS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.when(name.isin(NETWORK), F.concat(F.lit("net:"), name)), name)


def is_supported(name: Column) -> Column:
    return name.isin(*FILESYSTEMS, *NETWORK)


def is_local(label: Column) -> Column:
    return label.isin(LOCAL)


def network_host(device: Column) -> Column:
    """server of server:/export, //server/share and user@server:/path; null if there is none."""
    bare = F.regexp_replace(device, "^(//)+", "")
    host = F.split(F.substring_index(bare, "@", -1), "[:/]")[0]
    return F.when(host != "", host)


def mode_kind(mode: Column) -> Column:
    bits = mode.bitwiseAND(F.lit(TYPE_BITS))
    return F.when(bits == REGULAR, "File").when(bits == DIRECTORY, "Dir").when(bits == LINK, "Symlink").otherwise("Other")


def type_badge(kind: Column, path: Column) -> Column:
    """DIR, FILE, or the first four characters of the extension in ASCII capitals."""
    ext = paths.extension(path)
    return F.when(kind == "Dir", "DIR").when(ext == "", "FILE").otherwise(F.translate(F.substring(ext, 1, 4), paths.LOWER, paths.UPPER))


def category(kind: Column, path: Column) -> Column:
    """folder, or the category of the extension, or other."""
    ext, found = paths.ascii_lower(paths.extension(path)), F.when(kind == "Dir", "folder")
    for label, names in CATEGORIES.items():
        found = found.when(ext.isin(names), label)
    return found.otherwise("other")


def civil_date(days: Column) -> Column:
    """Days since 1970-01-01 as yyyy-MM-dd."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")


def format_mtime(mtime: Column, now: Column) -> Column:
    """Age in words up to a week, then the date (UTC). ``now``: Unix seconds."""
    age = now - mtime
    whole = lambda n: F.floor(age / n).cast("string")
    return (
        F.when(mtime <= 0, "Unknown").when(age < 60, "Just now").when(age < 3600, F.concat(whole(60), F.lit(" min ago")))
        .when(age < 86400, F.concat(whole(3600), F.lit(" hr ago"))).when(age < 604800, F.concat(whole(86400), F.lit(" days ago")))
        .otherwise(civil_date(F.floor(mtime / 86400)))
    )


def format_size(size: Column) -> Column:
    """Binary units with one decimal, ties to even."""
    found = None
    for power, unit in ((40, "TB"), (30, "GB"), (20, "MB"), (10, "KB")):
        text = F.concat(F.format_string("%.1f", F.bround(size.cast("decimal(20,0)") / F.lit(1 << power).cast("decimal(20,0)"), 1).cast("double")), F.lit(f" {unit}"))
        found = F.when(size >= (1 << power), text) if found is None else found.when(size >= (1 << power), text)
    return found.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def shorten(text: Column, most: int) -> Column:
    """The last characters behind an ellipsis, ``most`` in all."""
    keep = max(0, most - 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("…"), F.expr("''") if keep == 0 else F.substring(text, -keep, keep)))


def trigrams(text: Column) -> Column:
    """Distinct 3-byte windows of the lower-cased text, as numbers."""
    data = F.lower(text).cast("binary")
    n = F.octet_length(data)
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.conv(F.hex(F.call_function("substring", data, i, F.lit(3))), 16, 10).cast("bigint"))))
