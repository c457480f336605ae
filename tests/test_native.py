"""Native metadata as bytes: tree items, inodes, table records, event buffers."""

import struct

import pytest

from metasearch.sources import native
from metasearch.streaming import events


def inode(size, mode, mtime):
    data = bytearray(160)
    struct.pack_into("<Q", data, 16, size)
    struct.pack_into("<I", data, 52, mode)
    struct.pack_into("<Q", data, 136, mtime)
    return bytes(data)


def ref(name):
    return struct.pack("<QH", 0, len(name)) + name


def extref(parent, name):
    return struct.pack("<QQH", parent, 0, len(name)) + name


DIR, FILE = 0o040755, 0o100644


def test_tree_items(spark):
    items = [
        (256, 1, 0, inode(0, DIR, 1)), (257, 1, 0, inode(0, DIR, 2)), (257, 12, 256, ref(b"home")), (258, 1, 0, inode(1 << 40, FILE, 3)), (258, 12, 257, ref("é.txt".encode())), (258, 12, 256, ref(b"first")),
        (259, 1, 0, inode(5, FILE, 4)), (259, 13, 1, extref(257, b"far\xff")), (260, 1, 0, inode(5, FILE, 4)), (260, 12, 999, ref(b"orphan")), (261, 1, 0, b"short"), (261, 12, 256, ref(b"x")),
        (262, 1, 0, inode(1, FILE, 1)), (262, 12, 257, b"\0" * 8 + b"\xff\xff"), (263, 1, 0, inode(1, DIR, 1)), (263, 12, 264, ref(b"a")), (264, 1, 0, inode(1, DIR, 1)), (264, 12, 263, ref(b"b")),
    ]
    table = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in items], "objectid long, item_type int, offset long, data binary")
    got = {r["path"]: (r["size"], r["mtime"], r["kind"], r["native_id"], r["native_parent"]) for r in native.btrfs_files(table, "/mnt/").collect()}
    assert got == {"/mnt": (0, 1, "Dir", 256, 0), "/mnt/home": (0, 2, "Dir", 257, 256), "/mnt/first": (1 << 40, 3, "File", 258, 256), "/mnt/home/far�": (5, 4, "File", 259, 257)}
    assert native.btrfs_files(table.filter("objectid = 256")).first()["path"] == "/"
    assert {r["shard"] for r in native.sharded(table, 257, 1).select("shard").distinct().collect()} == {0, 1}


def test_cursor_and_ranges():
    top = native.LARGEST
    assert native.next_key((5, 1, 7)) == (5, 1, 8) and native.next_key((5, 1, top)) == (5, 2, 0) and native.next_key((5, 13, top)) == (6, 1, 0) and native.next_key((top, 13, top)) is None
    r = native.shard_ranges()
    assert len(r) == 17 and r[0] == (0, 7_999_999) and r[-1] == (128_000_000, top) and all(a[1] + 1 == b[0] for a, b in zip(r, r[1:], strict=False))


def test_inodes_with_links(spark):
    inodes = spark.createDataFrame([(2, DIR, 3, 0, 0, 1), (11, DIR, 2, 9, 7, 1), (12, FILE, 2, 5, 1, 2), (13, FILE, 0, 5, 0, 2), (14, 0, 1, 5, 0, 2)], "id long, mode long, links long, size_low long, size_high long, mtime long")
    entries = spark.createDataFrame([(2, 11, "d", 1), (11, 12, "a", 2), (2, 12, "b", 3), (2, 13, "free", 4), (2, 14, "none", 5), (11, 2, "..", 6)], "parent long, id long, name string, ord long")
    got = {r["path"]: (r["size"], r["kind"], r["native_parent"]) for r in native.ext_files(inodes, entries, "/x/").collect()}
    assert got == {"/x/d": (9, "Dir", 2), "/x/d/a": ((1 << 32) + 5, "File", 11), "/x/b": ((1 << 32) + 5, "File", 2)}


def test_listed_paths(spark):
    found = spark.createDataFrame([("/a",), ("/gone",)], "path string")
    stats = spark.createDataFrame([("/a", 3, 4, 0o120777)], "path string, size long, mtime long, mode long")
    assert [(r["path"], r["kind"], r["native_id"]) for r in native.listed_files(found, stats, "apfs").collect()] == [("/a", "Symlink", 0)]


def attribute(kind, value, resident=True):
    if not resident:
        body = struct.pack("<BBHHH", 1, 0, 64, 0, 0) + b"\0" * 16 + struct.pack("<H", 64) + b"\0" * 6 + b"\0" * 8 + struct.pack("<QQ", value[1], value[1]) + value[0]
    else:
        body = struct.pack("<BBHHHIHH", 0, 0, 24, 0, 0, len(value), 24, 0) + value
    body += b"\0" * (-len(body) % 8)
    return struct.pack("<II", kind, len(body) + 8) + body


def file_name(parent, seq, name, namespace, size=0, flags=0):
    text = name.encode("utf-16-le")
    return struct.pack("<Q", parent | seq << 48) + b"\0" * 40 + struct.pack("<QII", size, flags, 0) + bytes([len(text) // 2, namespace]) + text


def record(attrs, sequence=1, flags=1, base=0, size=1024):
    body = b"".join(attrs) + b"\xff\xff\xff\xff"
    data = bytearray(b"FILE" + struct.pack("<HH", 48, 3) + b"\0" * 8 + struct.pack("<HHHH", sequence, 1, 56, flags) + b"\0" * 8 + struct.pack("<Q", base) + b"\0" * 16 + body)
    data += b"\0" * (size - len(data))
    fix = [b"\x07\x00"]
    for end in (512, 1024):
        fix.append(bytes(data[end - 2 : end]))
        data[end - 2 : end] = b"\x07\x00"
    data[48:54] = b"".join(fix)
    return bytes(data)


def times(unix):
    return b"\0" * 8 + struct.pack("<Q", (unix + 11_644_473_600) * 10_000_000) + b"\0" * 16


def table_records():
    return {
        5: record([attribute(0x30, file_name(5, 5, ".", 3))], 5, 3),
        20: record([attribute(0x10, times(77)), attribute(0x30, file_name(5, 0, "LONGNA~1", 2)), attribute(0x30, file_name(5, 0, "Long name", 1, flags=0x10000000))], 3, 3),
        21: record([attribute(0x10, times(78)), attribute(0x30, file_name(20, 3, "file.txt", 3, 9)), attribute(0x30, file_name(5, 0, "hard link", 0)), attribute(0x80, b"12345")], 1, 1),
        22: record([attribute(0x30, file_name(20, 4, "stale", 3))]),
        23: record([attribute(0x30, file_name(5, 0, "unused", 3))], flags=0),
        24: record([attribute(0x30, file_name(5, 0, "from part", 0, 1000))], base=21 | 1 << 48),
        25: record([attribute(0x30, file_name(5, 0, "other seq", 0, 9999))], base=21 | 9 << 48),
        26: record([attribute(0x30, file_name(20, 3, "big", 3)), attribute(0x80, (b"", 1 << 33), False)]),
    }


WANT = {
    "/v/Long name": (0, 77, "Dir", 20), "/v/Long name/file.txt": (1000, 78, "File", 21), "/v/hard link": (1000, 78, "File", 21), "/v/from part": (1000, 78, "File", 21), "/v/Long name/big": (1 << 33, 0, "File", 26),
}


def test_table_records(spark):
    broken = bytearray(table_records()[20])
    broken[510:512] = b"xx"
    rows = [(n, bytearray(d)) for n, d in table_records().items()] + [(30, broken), (31, bytearray(1024)), (32, bytearray(b"BAAD" + b"\0" * 1020))]
    found = native.parse_records(spark.createDataFrame(rows, "number long, data binary"))
    assert {r["path"]: (r["size"], r["mtime"], r["kind"], r["native_id"]) for r in native.ntfs_files(found, "/v").collect()} == WANT


def test_image(spark, tmp_path):
    """A volume whose table lies in two runs."""
    sector, per, records = 512, 2, 40
    cluster = sector * per
    boot = bytearray(512)
    boot[3:7] = b"NTFS"
    struct.pack_into("<HB", boot, 11, sector, per)
    struct.pack_into("<Q", boot, 48, 4)
    struct.pack_into("<b", boot, 64, -10)
    run_list = bytes([0x11, 10, 4, 0x11, records - 10, 20]) + b"\0\0"
    image = bytearray(100 * cluster)
    image[:512] = boot
    own = table_records() | {0: record([attribute(0x80, (run_list, records * 1024), False)])}
    for n, data in own.items():
        at = (4 + n if n < 10 else 24 + n - 10) * cluster
        image[at : at + 1024] = data
    path = tmp_path / "image"
    path.write_bytes(image)
    found = native.parse_records(native.image_records(spark, str(path), 7))
    assert {r["path"]: (r["size"], r["mtime"], r["kind"], r["native_id"]) for r in native.ntfs_files(found, "/v").collect()} == WANT


def test_geometry_and_runs():
    assert native.runs(bytes([0x21, 4, 0x10, 0x00, 0x11, 2, 0xFF, 0]), 10) == [(0, 40, 160), (40, 20, 150)]
    for bad in (b"\x10", bytes([0x01, 5, 0]), bytes([0x11, 1]), bytes([0x11, 1, 0xF0])):
        with pytest.raises(ValueError):
            native.runs(bad, 10)
    for bad in (bytes(512), b"\0\0\0NTFS" + bytes(505)):
        with pytest.raises(ValueError):
            native.geometry(bad)
    assert native.unix_time(116_444_736_000_000_000) == 0


def info(kind, handle, name=None):
    body = b"\0" * 8 + struct.pack("<Ii", len(handle), 1) + handle + (name + b"\0" if name is not None else b"")
    return struct.pack("<BBH", kind, 0, len(body) + 4) + body


def event(mask, *infos):
    body = b"".join(infos)
    return struct.pack("<IBBHQii", 24 + len(body), 3, 0, 24, mask, -1, 0) + body


def test_event_buffers(spark):
    data = event(0x100, info(2, b"hh", b"new.txt"), info(99, b"")) + event(0x10000000 | 0x40000000, info(10, b"a", b"old"), info(12, b"b", b"new")) + event(0x4, info(1, b"obj")) + event(0x4000)
    rows = events.parse(spark.createDataFrame([(1, bytearray(data))], "seq long, data binary")).collect()
    assert [(r["mask"], r["role"], r["name"]) for r in rows] == [(["CREATE"], "Current", "new.txt"), (["RENAME", "ONDIR"], "Old", "old"), (["RENAME", "ONDIR"], "New", "new"), (["ATTRIB"], "Object", None), (["Q_OVERFLOW"], None, None)]
    whole = event(0x100, info(2, b"hh", b"x"))
    for bad in (whole[:10], whole[:-3], whole[:4] + b"\x09" + whole[5:], event(0x100, info(2, b"hh")), event(0x100, b"\2\0\xff\xff"), event(0x100, b"\2\0")):
        with pytest.raises(ValueError):
            events.events(bad)
