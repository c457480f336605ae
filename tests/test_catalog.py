"""Overlay, store, streams, namespaces, folders, parsers and servers."""

import io
import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from metasearch import serve
from metasearch.operators import hierarchy, namespace, overlay, search
from metasearch.plans.query import parse
from metasearch.schema import CHANGE_SCHEMA, as_files
from metasearch.sources import mounts, text
from metasearch.store import DamagedError, LockedError, Reader, StaleError, Store
from metasearch.streaming import changes as stream


def files(spark, rows):
    return as_files(spark.createDataFrame(rows, "path string, size long"))


def changes(spark, rows):
    """Rows of (seq, op, path, size)."""
    df = spark.createDataFrame(rows, "seq long, op string, path string, size long").withColumn("kind", F.lit("File")).withColumn("fs", F.lit("ext4"))
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(0)).cast(f.dataType).alias(f.name) for f in CHANGE_SCHEMA])


def paths_of(df):
    return sorted(r["path"] for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "catalog"))


BASE = [("/d/AlphaDocument.txt", 1), ("/d/beta.rs", 2), ("/d/gamma/notes.txt", 3)]
CHANGES = [(1, "Remove", "/d/AlphaDocument.txt", None), (2, "Upsert", "/d/beta.rs", 20), (3, "Upsert", "/d/new.rs", 5), (4, "Upsert", "/d/gone", 1), (5, "Remove", "/d/gone", None)]


def test_overlay(spark):
    live = overlay.overlay(files(spark, BASE), changes(spark, CHANGES))
    assert {r["path"]: r["size"] for r in live.collect()} == {"/d/beta.rs": 20, "/d/gamma/notes.txt": 3, "/d/new.rs": 5}
    row = overlay.counts(files(spark, BASE), changes(spark, CHANGES)).first()
    assert (row["base_rows"], row["upserts"], row["removes"], row["scanned"]) == (3, 2, 2, 7)
    assert paths_of(overlay.overlay(files(spark, [("/a/b", 1), ("/a", 1)]), changes(spark, [(1, "Remove", "/a", None)]))) == ["/a/b"]


def test_changes_are_checked(spark):
    assert overlay.validate_changes(changes(spark, CHANGES)) is not None
    for bad in ("", "rel", "/a/../b", "/" + "x" * 40_000):
        with pytest.raises(ValueError):
            overlay.validate_changes(changes(spark, [(1, "Remove", bad, None)]))


def test_store(spark, store):
    with pytest.raises(FileNotFoundError):
        store.files()
    assert store.build(files(spark, BASE)).records == 3 and paths_of(store.records()) == sorted(p for p, _ in BASE)
    reader = Reader(store)
    before = reader.files()
    assert reader.files() is before
    store.apply(7, changes(spark, CHANGES))
    assert store.apply(7, changes(spark, [(9, "Remove", "/d/beta.rs", None)])).batches == [7]  # a replay adds nothing
    assert paths_of(reader.files()) == ["/d/beta.rs", "/d/gamma/notes.txt", "/d/new.rs"] and store.status()["store"] == "base+changes"
    assert not store.needs_compaction() and store.needs_compaction(1)
    m = store.compact()
    assert (m.generation, m.records, m.batches) == (2, 3, []) and paths_of(reader.files()) == ["/d/beta.rs", "/d/gamma/notes.txt", "/d/new.rs"]
    assert paths_of(before) == sorted(p for p, _ in BASE)  # a snapshot stays readable
    store.clean()
    assert paths_of(store.files()) == ["/d/beta.rs", "/d/gamma/notes.txt", "/d/new.rs"]


def test_stored_searches_reach_the_scan(spark, store):
    from metasearch.operators import search
    from metasearch.plans.query import parse

    rows = [(r"C:\Data\Mixed\File.txt", 1), ("/data/mixed/file.txt", 2), ("/data/other", 3), ("/DATA/Mixed/new.rs", 4)]
    store.build(files(spark, rows))
    for text in ("under:/data/mixed file", "under:c:/data", "mixed", "mixed/f", "mixed\\f", "under:/data/ new"):
        query = parse(text)
        assert paths_of(search.matches(store.searchable(), query)) == paths_of(search.matches(files(spark, rows), query))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = search.matches(store.searchable(), parse("under:/data/mixed file"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "StringStartsWith(path_key,/data/mixed)" in pushed and "StringContains(path_key,file)" in pushed
    store.apply(0, changes(spark, [(1, "Upsert", "/data/mixed/added-file", 1), (2, "Remove", "/data/mixed/file.txt", None)]))
    assert paths_of(search.matches(store.searchable(), parse("under:/data/mixed file"))) == ["/data/mixed/added-file"]


def test_stale(spark, store):
    store.build(files(spark, BASE))
    store.mark_stale("lost events")
    with pytest.raises(StaleError, match="lost events"):
        store.files()
    store.build(files(spark, BASE))
    assert store.files().count() == 3


def test_steps_that_die_leave_nothing_that_is_read(spark, store):
    store.build(files(spark, BASE))
    files(spark, BASE).write.parquet(store._base(2))  # a build that died before the pointer
    changes(spark, CHANGES).write.parquet(store._batch(1, 0))  # a batch that died before the pointer
    assert paths_of(store.files()) == sorted(p for p, _ in BASE)
    assert store.apply(0, changes(spark, CHANGES[:1])).changes == 1 and store.files().count() == 2
    assert store.compact().generation == 3


def test_format_and_unsafe_paths(spark, store):
    with pytest.raises(ValueError):
        store.build(files(spark, [("rel", 1)]))
    store.build(files(spark, BASE))
    store._put("current.json", json.dumps({"format": 9}))
    with pytest.raises(ValueError):
        store.manifest()


def test_writer_lock_and_publication(spark, store):
    store.build(files(spark, BASE))
    assert store.lock() and not store.lock()
    store.unlock()
    assert store.lock()
    assert store.publish(files(spark, BASE[:1]), 2, 2) is None and store.publish(files(spark, []), 1, 0) is None and store.files().count() == 3
    assert store.publish(files(spark, BASE[:1]), 2, 1).records == 1


def test_a_second_writer_is_kept_out(spark, store, tmp_path):
    store.build(files(spark, BASE))
    other = type(store)(spark, store.root)
    assert other.lock()
    for step in (lambda: store.build(files(spark, BASE)), lambda: store.apply(0, changes(spark, CHANGES)), store.compact):
        with pytest.raises(LockedError):
            step()
    assert paths_of(store.files()) == sorted(p for p, _ in BASE)  # readers go on
    changes(spark, CHANGES[:2]).coalesce(1).write.parquet(str(tmp_path / "in"))
    follow = lambda: stream.follow(stream.read_changes(spark, str(tmp_path / "in")), store, str(tmp_path / "progress")).awaitTermination()
    with pytest.raises(PySparkException):
        follow()
    other.unlock()
    follow()  # the batch that was kept out comes again; the catalog isn't stale
    assert store.manifest().changes == 2 and not store._exists("_LOCK")


def test_damage_is_seen(spark, store):
    """A file that is missing, cut or changed raises instead of answering less."""
    import glob

    import pyarrow.parquet as pq

    store.build(files(spark, BASE))
    store.apply(0, changes(spark, CHANGES[:2]))
    assert store.files().count() > 0
    for kind in ("base/g=1", "index/g=1", "changes/g=1/b=0"):
        part = max(glob.glob(f"{store.root}/{kind}/*.parquet"), key=os.path.getsize)
        with open(part, "rb") as f:
            whole = f.read()
        os.remove(part)
        with pytest.raises(DamagedError):
            store.files()
        with open(part, "wb") as f:
            f.write(whole[:-20])
        with pytest.raises(DamagedError):
            Reader(store).files()
        with open(part, "wb") as f:
            f.write(whole)
    part = max(glob.glob(f"{store.root}/base/g=1/*.parquet"), key=os.path.getsize)
    crc = f"{os.path.dirname(part)}/.{os.path.basename(part)}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    with open(part, "rb") as f:
        data = bytearray(f.read())
    at = pq.ParquetFile(part).metadata.row_group(0).column(0)
    data[at.data_page_offset + at.total_compressed_size - 3] ^= 0xFF  # the size stays
    with open(part, "wb") as f:
        f.write(data)
    with pytest.raises(Py4JJavaError, match="CRC checksum"):
        store.base().collect()


def test_late_batches_lie_on_top_after_a_compaction(spark, store):
    store.build(files(spark, BASE))
    store.apply(0, changes(spark, [(9, "Upsert", "/d/beta.rs", 90)]))
    store.apply(1, changes(spark, [(5, "Upsert", "/d/beta.rs", 50)]))  # within a generation seq decides
    assert {r["size"] for r in store.files().filter("path = '/d/beta.rs'").collect()} == {90}
    store.compact()
    store.apply(0, changes(spark, [(5, "Upsert", "/d/beta.rs", 51)]))  # after it, the batch
    assert {r["size"] for r in store.files().filter("path = '/d/beta.rs'").collect()} == {51}


def test_a_batch_of_100_000_changes(spark, store, tmp_path):
    store.build(files(spark, BASE))
    rows = spark.range(100_000).selectExpr("id as seq", "'Upsert' as op", "concat('/many/', id) as path", "id as size")
    rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CHANGE_SCHEMA]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream.follow(stream.read_changes(spark, str(tmp_path / "in")), store, str(tmp_path / "progress")).awaitTermination()
    assert store.files().count() == 100_003 and store.manifest().batches == [0]
    with pytest.raises(ValueError, match="more than"):
        overlay.validate_changes(rows)


def test_the_index_leaves_most_of_the_base_unread(spark, store):
    """Rows that the scan puts out, with the index and without; the answers are the same, and changes are found as well."""
    from metasearch.sources.generate import synthetic

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        store.build(synthetic(spark, 100_000))
        query = parse(f"needle{99_999:08x}")

        def scanned(df):
            rows = search.matches(df, query)
            found = sorted(r["path"] for r in rows.collect())
            leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
            return found, leaves.head().metrics().apply("numOutputRows").value()

        reader = Reader(store)
        with_index, read = scanned(reader.rows(query))
        without, all_rows = scanned(reader.files())
        assert with_index == without and len(with_index) == 1 and all_rows == 100_000 and read < 10_000, read
        assert store.blocks(parse("ne")) is None and store.blocks(parse("qqqzzz")) == []
        store.apply(0, changes(spark, [(1, "Upsert", f"/new/needle{99_999:08x}", 1), (2, "Remove", without[0], None)]))
        assert [r["path"] for r in search.matches(reader.rows(query), query).collect()] == [f"/new/needle{99_999:08x}"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_block_ranges():
    from metasearch.operators import trigram

    assert trigram.block_ranges([7, 1, 2, 9, 30], 64) == [(1, 2), (7, 7), (9, 9), (30, 30)]
    assert trigram.block_ranges([7, 1, 2, 9, 30], 2) == [(1, 9), (30, 30)] and trigram.block_ranges([], 2) == []


def test_scan_and_watch(spark, store, tmp_path):
    """From a filesystem's tables to records, from the command line; then a folder of event files."""
    run = lambda *args: serve.main([*args, "--store", store.root], out := io.StringIO(), (), spark) or out.getvalue()
    inodes = [(2, 0o040755, 3, 0, 0, 1), (11, 0o040755, 2, 0, 0, 1), (12, 0o100644, 1, 5, 1, 2)]
    spark.createDataFrame(inodes, "id long, mode long, links long, size_low long, size_high long, mtime long").write.parquet(str(tmp_path / "inodes"))
    spark.createDataFrame([(2, 11, "d", 1), (11, 12, "a", 2)], "parent long, id long, name string, ord long").write.parquet(str(tmp_path / "entries"))
    assert "2 records" in run("scan", "--fs", "ext4", "--prefix", "/x", "--table", f"inodes={tmp_path}/inodes", "--table", f"entries={tmp_path}/entries")
    assert "1 records" in run("scan", "--fs", "ext4", "--prefix", "/x", "--root", "/x/d/a", "--table", f"inodes={tmp_path}/inodes", "--table", f"entries={tmp_path}/entries")
    with pytest.raises(ValueError):
        run("scan", "--fs", "nfs")
    spark.createDataFrame([(1, ["CREATE"], "Current", True, True, "/x/new", 7), (2, ["DELETE"], "Current", True, False, "/x/d/a", None)], "seq long, mask array<string>, role string, named boolean, present boolean, path string, size long").coalesce(1).write.parquet(str(tmp_path / "events"))
    assert run("watch", "--events", str(tmp_path / "events"), "--progress", str(tmp_path / "p")) == "batch 0: 2 events\n"
    assert [(r["path"], r["size"]) for r in store.files().collect()] == [("/x/new", 7)]


def test_stream(spark, store, tmp_path):
    store.build(files(spark, BASE))
    for i in range(0, 5, 2):
        changes(spark, CHANGES[i : i + 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream.follow(stream.read_changes(spark, str(tmp_path / "in")), store, str(tmp_path / "progress"), compact_bytes=1).awaitTermination()
        assert {r["path"]: r["size"] for r in store.files().collect()} == {"/d/beta.rs": 20, "/d/gamma/notes.txt": 3, "/d/new.rs": 5}


def test_stream_fails_closed(spark, store, tmp_path):
    store.build(files(spark, BASE))
    changes(spark, [(1, "Remove", "../x", None)]).write.parquet(str(tmp_path / "in"))
    with pytest.raises(PySparkException):
        stream.follow(stream.read_changes(spark, str(tmp_path / "in")), store, str(tmp_path / "progress")).awaitTermination()
    with pytest.raises(StaleError):
        store.files()


def test_rescan_reasons(spark):
    why = lambda *masks, atomic=True: stream.rescan_reason(spark.createDataFrame([(list(m),) for m in masks], "mask array<string>"), atomic)
    assert why(["CREATE"]) is None and "overflow" in why(["CREATE"], ["Q_OVERFLOW"]) and "directory" in why(["ONDIR", "MOVED_TO"])
    assert why(["MOVED_FROM"]) is None and "other side" in why(["MOVED_FROM"], atomic=False)


INODES = "id long, parent long, parent_seq long, sequence long, name string, is_dir boolean, size long, mtime long"


def test_deep_trees_cycles_and_orphans(spark):
    deep = [(100 + i, 99 + i if i else 5, 0, 1, f"d{i}", True, 0, 0) for i in range(150)]
    odd = [(5, 5, 0, 1, ".", True, 0, 0), (1, 2, 0, 1, "a", True, 0, 0), (2, 1, 0, 1, "b", True, 0, 0), (3, 99999, 0, 1, "orphan", False, 0, 0), (4, 4, 0, 1, "self", True, 0, 0), (6, 1, 0, 1, "in-cycle", False, 0, 0), (7, 8, 0, 1, "below-file", False, 0, 0), (8, 5, 0, 1, "file", False, 0, 0)]
    stale = [(50, 100, 2, 1, "stale", True, 0, 0), (51, 50, 1, 1, "child", False, 0, 0), (52, 100, 1, 1, "fresh", False, 9, 0)]
    got = {r["id"]: r["path"] for r in namespace.inode_paths(spark.createDataFrame(deep + odd + stale, INODES), prefix="/mnt/").collect()}
    assert set(got) == {100 + i for i in range(150)} | {8, 52}
    assert got[249] == "/mnt/" + "/".join(f"d{i}" for i in range(150)) and got[52] == "/mnt/d0/fresh" and got[8] == "/mnt/file"


def test_hard_links_open_a_directory_once(spark):
    inodes = spark.createDataFrame([(2, True), (10, True), (11, True), (12, False)], "id long, is_dir boolean")
    links = spark.createDataFrame([(2, 10, "a", 1), (2, 11, "b", 2), (11, 10, "again", 3), (10, 12, "f", 4), (11, 12, "g", 5), (10, 2, "..", 6), (10, 10, ".", 7)], "parent long, id long, name string, ord long")
    assert paths_of(namespace.linked_paths(links, inodes)) == ["/a", "/a/f", "/b", "/b/again", "/b/g"]


def test_folders(spark):
    rows = as_files(spark.createDataFrame([(r"C:\Users\Alex\report.txt", 42, "File"), (r"\\server\share\team\plan.txt", 42, "File"), ("/empty", 0, "Dir"), ("/z/zero.LOG", 0, "File"), ("/z/.gitignore", 3, "Symlink"), ("/", 0, "Dir")], "path string, size long, kind string"))
    got = {r["folder"]: (r["bytes"], r["count"]) for r in hierarchy.rollup(rows).collect()}
    assert got["/"] == (88, 4) and got["C:/"] == got["C:/Users"] == got["C:/Users/Alex"] == (42, 1) and got["//server/share"] == (42, 1) and got["/empty"] == (0, 0) and got["/z"] == (4, 2)
    assert "//server" not in got
    child = {(r["parent"], r["child"]) for r in hierarchy.children(rows).collect()}
    assert {("/", "C:/"), ("/", "//server/share"), ("/", "/empty"), ("/", "/"), ("C:/", "C:/Users")} <= child
    # the tiles of every folder have the roll-up's sums, of its children and of the files right in it
    for folder in ("/", "C:/", "C:/Users", "//server/share", "/z", "/empty", "/nowhere"):
        own = {r["path"]: (r["bytes"], r["count"]) for r in hierarchy.tiles(rows, folder).collect() if r["folder"]}
        assert own == {c: (max(1, got[c][0]), got[c][1]) for p, c in child if p == folder}, folder
    tiles = [tuple(r) for r in hierarchy.tiles(rows, "/z").collect()]
    assert tiles == [("/z/.gitignore", ".gitignore", 3, 1, False, "gitignore"), ("/z/zero.LOG", "zero.LOG", 1, 1, False, "log")]


def test_layout():
    got = hierarchy.layout([50, 30, 20], 0, 0, 100, 50)
    assert [g[0] for g in got] == [0, 1, 2] and got[0][1:] == (0, 0, 50, 50) and sum(g[3] * g[4] for g in got) == pytest.approx(5000)
    assert hierarchy.layout([], 0, 0, 9, 9) == [] and hierarchy.layout([1], 0, 0, 1, 9) == []
    assert hierarchy.layout([10_000, 1], 0, 0, 100, 10)[0][3] == pytest.approx(92)


def test_text_parsers(spark, tmp_path):
    lines = lambda rows: spark.createDataFrame(list(enumerate(rows, 1)), "line long, value string")
    with pytest.raises(PySparkException, match="unknown mark on line 2"):
        text.zfs_diff(lines(["+\t/x", "?\t/y"])).collect()
    with pytest.raises(PySparkException, match="no path on line 1"):
        text.zfs_diff(lines(["R\t/a\t/b"])).collect()
    (tmp_path / "nul").write_bytes(b"/A/a file\0/A/with\nnewline\0\0/bad\xff\0")
    assert paths_of(text.read_nul_paths(spark, str(tmp_path / "nul"))) == ["/A/a file", "/A/with\nnewline"]
    assert text.snapshot_command("tank/a", 5, True) == ["snapshot", "-r", f"tank/a@{text.SNAPSHOT_PREFIX}5"]
    for bad in ("", "a@b", "a b"):
        with pytest.raises(ValueError):
            text.snapshot_name(bad, 1)
    with pytest.raises(ValueError):
        text.destroy_command("tank@other-5")


def test_mounts(spark):
    for label, error in (("zfs", NotImplementedError), ("net:nfs", ValueError), ("xfs", ValueError)):
        with pytest.raises(error):
            mounts.lane(label)
    assert mounts.validate_roots(["/a/b", "/a/b/", "/a"], ["/a"]) == ["/a/b", "/a"] and mounts.validate_roots([], []) == []
    for roots in ([], ["/ab"], ["rel"], ["/a/../b"], ["/a"] * 33):
        with pytest.raises(ValueError):
            mounts.validate_roots(roots, ["/a"])
    table = spark.createDataFrame([("/dev/a", "/", "ext4")], "device string, mountpoint string, fs string")
    with pytest.raises(ValueError, match="/nowhere"):
        mounts.resolve(spark.createDataFrame([("/nowhere",)], "mountpoint string"), table)


def test_many_roots_meet_the_paths_in_a_join(spark):
    rows = files(spark, [("/a/b/c", 1), ("/a/bc", 2), ("/d/", 3), ("C:/x/y", 4), ("/z", 5)])
    roots = spark.createDataFrame([("/a/b/",), ("/d",), ("C:/",), ("/nowhere",)], "root string")
    want = ["/a/b/c", "/d/", "C:/x/y"]
    assert paths_of(mounts.scanned_by(rows, roots)) == paths_of(mounts.scanned_by(rows, roots, few=1)) == want
    assert mounts.scanned_by(rows, roots.limit(0)).count() == 0 and mounts.scanned_by(rows, spark.createDataFrame([("/",)], "root string")).count() == 5


def test_servers(spark, store, tmp_path, monkeypatch):
    files(spark, BASE).write.parquet(str(tmp_path / "table"))
    run = lambda *args, lines=(): serve.main([*args], out := io.StringIO(), lines, spark) or out.getvalue()
    at = ["--store", store.root]
    assert "3 records" in run("index", *at, str(tmp_path / "table"))
    assert run("search", *at, "document", "ext:txt") == "/d/AlphaDocument.txt\n" and run("search", *at, "--json-paths", "gamma").startswith('{"paths": ["/d/gamma/notes.txt"], "matched": 1, "returned": 1')
    assert json.loads(run("search", *at, "--json", "--limit", "0", "beta"))["records"][0]["kind"] == "file"
    with pytest.raises(ValueError):
        run("search", *at, "--scope", "relative", "x")
    asked = [json.dumps({"query": "notes", "limit": 5, "metadata": True}), "", json.dumps({"query": "x", "scopes": ["rel"]})]
    answers = [json.loads(x) for x in run("serve", *at, lines=asked).splitlines()]
    assert answers[0]["records"][0]["path"] == "/d/gamma/notes.txt" and "error" in answers[1]
    with pytest.raises(json.JSONDecodeError):
        run("serve", *at, lines=["{"])
    assert json.loads(run("status", *at))["records"] == 3 and "generation 2" in run("compact", *at)
    monkeypatch.setenv("METASEARCH_ROOTS", "/d/gamma")
    calls = [("initialize", {}), ("ping", {}), ("tools/list", {}), ("nope", {}), ("tools/call", {"name": "search", "arguments": {"query": "", "limit": 1}}), ("tools/call", {"name": "status"}), ("tools/call", {"name": "x"})]
    messages = [json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}) for i, (m, p) in enumerate(calls)] + [json.dumps({"method": "notify"})]
    replies = [json.loads(x) for x in run("tools", *at, lines=messages).splitlines()]
    assert len(replies) == 7 and replies[3]["error"]["code"] == -32601 and replies[4]["result"]["structuredContent"]["paths"] == ["/d/gamma/notes.txt"]
    assert replies[5]["result"]["structuredContent"]["records"] == 3 and replies[6]["result"]["isError"]
    with pytest.raises(ValueError):
        serve.allowed_roots("relative")
    with pytest.raises(ValueError):
        from metasearch.render import check_size

        check_size("x" * (17 << 20))
