"""The query language, predicates, ranking, and their traps."""

import pytest
from pyspark.sql import functions as F

from metasearch.functions import labels, paths
from metasearch.operators import search, trigram, view
from metasearch.plans.query import Query, Sort, parse, parse_size, tokenize, validate
from metasearch.schema import FILE_SCHEMA, as_files, check
from metasearch.sources import generate


def files(spark, rows):
    """Rows of (path, mtime) or (path, mtime, size, kind)."""
    return as_files(spark.createDataFrame([(r[0], r[1], *(r[2:4] if len(r) > 2 else (1, "File"))) for r in rows], "path string, mtime long, size long, kind string"))


def hits(spark, rows, query):
    query = parse(query) if isinstance(query, str) else query
    return [r["path"] for r in search.ranked(search.matches(files(spark, rows), query), query).collect()]


@pytest.mark.parametrize(("text", "want"), [
    ('a "b c" d', ["a", "b c", "d"]), ('x"y z"w', ["xy zw"]), ('"open to the end', ["open to the end"]), ("  ", []), ('""', []), ("a\tb\nc", ["a", "b", "c"]), ('"" a', ["a"]),
])
def test_tokenize(text, want):
    assert tokenize(text) == want


def test_parse():
    q = parse('Report ext:.PDF,txt kind:file,d fs:ext3,smb3,xfs size:1k..2M under:/Home "Two Words"')
    assert q == Query(("report", "two words"), ("pdf", "txt"), ("File", "Dir"), ("ext4", "net:smb3", "xfs"), 1024, 2 << 20, "/home")
    assert parse('"ext:rs"').exts == ("rs",) and parse("ext:.").exts == ("",) and parse("ext:").exts == ()
    assert parse("kind:bogus,File").kinds == () and parse("under:/a under:/b").under == "/b" and parse("under:").under == ""
    assert (parse("size:>1M").min_size, parse("size:<4k").max_size, parse("size:9").min_size) == (1 << 20, 4096, 9)
    assert (parse("size:>=5").min_size, parse("size:>1 size:<2").max_size, parse("size:>3 size:..9").min_size) == (None, 2, None)
    assert parse("note:this").terms == ("note:this",)


@pytest.mark.parametrize(("text", "want"), [("1", 1), ("+5", 5), ("2K", 2048), ("1t", 1 << 40), ("100MB", None), ("1.5M", None), ("", None), ("k", None), ("-1", None), ("99999999999999999999", None)])
def test_parse_size(text, want):
    assert parse_size(text) == want


def test_validate():
    assert validate(Query(limit=1)).limit == 1
    for bad in (Query(limit=0), Query(limit=10_001), Query(terms=("x",) * 33), Query(scope_roots=("relative",)), Query(scope_roots=("/a",) * 33), Query(terms=("x" * 40_000,))):
        with pytest.raises(ValueError):
            validate(bad)


def test_ranks_and_limits(spark):
    rows = [("/home/u/code/main.rs", 5), ("/home/u/doc/main-notes.txt", 9), ("/opt/main/lib.rs", 1)]
    assert hits(spark, rows, "main") == ["/home/u/doc/main-notes.txt", "/home/u/code/main.rs", "/opt/main/lib.rs"]
    found, seen = search.search(files(spark, rows), Query(("main",), limit=1))
    assert found.count() == 1 and seen.get["matched"] == 3
    assert hits(spark, rows, "") == ["/home/u/doc/main-notes.txt", "/home/u/code/main.rs", "/opt/main/lib.rs"]
    newest = [("/old.txt", 10), ("/newest.txt", 30), ("/middle.txt", 20)]
    assert hits(spark, newest, Query(sort=Sort.MTIME, limit=2)) == ["/newest.txt", "/middle.txt"]


def test_name_beats_path(spark):
    rows = [("/home/u/projects/config.rs", 0), ("/home/u/config/main.rs", 0), ("/x/config", 0)]
    got = {r["path"]: r["score"] for r in search.matches(files(spark, rows), parse("config")).collect()}
    assert got == {"/home/u/projects/config.rs": (1 << 20) + 256, "/home/u/config/main.rs": 64, "/x/config": (1 << 20) + (1 << 24) + 256}
    assert hits(spark, rows, "config nothing") == []
    twice = {r["path"]: r["score"] for r in search.matches(files(spark, rows), parse("config config")).collect()}
    assert twice["/home/u/config/main.rs"] == 128


def test_score_is_capped_and_in_bytes(spark):
    many = search.matches(files(spark, [("/x/aa", 0)]), Query(("aa",) * 300)).first()["score"]
    assert many == (1 << 32) - 1
    row = search.matches(files(spark, [("/x/éa", 0)]), parse("a")).first()["score"]
    assert row == 4096 + 256 - 2


@pytest.mark.parametrize(("path", "root", "want"), [
    ("/home/a/file.txt", "/home/a", True), ("/home/a", "/home/a", True), ("/home/ab/file.txt", "/home/a", False), (r"c:\Users\A\file.txt", "C:/users/a", True), ("/home/a", "/home/a/", False), ("rel", "", False), ("/x", "", True),
])
def test_under(spark, path, root, want):
    assert spark.range(1).select(paths.under_ci(F.lit(path), root).alias("x")).first()["x"] is want


def test_scopes(spark):
    rows = [("/allowed/a/f", 0), ("/allowed/ab/f", 0), ("/denied/f", 0), ("/allowed/a/../secret.txt", 0)]
    assert hits(spark, rows, Query(scope_roots=("/allowed/a", "/denied"), scope_case_sensitive=True)) == ["/allowed/a/f", "/denied/f"]
    case = [("/Users/Alice/file.txt", 0), ("/users/alice/file.txt", 0)]
    assert hits(spark, case, Query(scope_roots=("/users/alice",), scope_case_sensitive=True)) == ["/users/alice/file.txt"]
    assert len(hits(spark, case, Query(scope_roots=("/USERS/alice",)))) == 2
    limited = [("/denied/needle.txt", 9), ("/allowed/path/has-needle-here.txt", 1)]
    assert hits(spark, limited, Query(("needle",), scope_roots=("/allowed",), limit=1)) == ["/allowed/path/has-needle-here.txt"]


def test_sizes_kinds_and_extensions(spark):
    rows = [("/a.TXT", 0, 1_500_000, "File"), ("/b", 0, 3 << 20, "Dir"), ("/c.tar.gz", 0, 5, "Symlink"), ("/.bashrc", 0, 0, "File"), ("/d.", 0, 0, "Other")]
    assert hits(spark, rows, "size:1M..2M") == ["/a.TXT"]
    assert hits(spark, rows, "ext:txt") == ["/a.TXT"] and hits(spark, rows, "ext:gz,x kind:l") == ["/c.tar.gz"]
    assert hits(spark, rows, "ext:.") == ["/.bashrc", "/b", "/d."] and hits(spark, rows, "kind:bogus size:x") == ["/.bashrc", "/a.TXT", "/b", "/c.tar.gz", "/d."]


def test_unsafe_paths_never_match(spark):
    rows = [(p, 0) for p in ("rel/x", "/a/../b", "/a/./b", "/ok", "C:/ok", r"C:\ok", r"\\h\s\ok", "/nul\0ok", "/ok\n", "/...", "C:ok")]
    assert sorted(hits(spark, rows, "")) == sorted(["/ok", "C:/ok", r"C:\ok", r"\\h\s\ok", "/ok\n", "/..."])


def test_sorts(spark):
    rows = [("/b/Alpha", 1, 5, "File"), ("/a/beta", 2, 5, "File"), ("/c/alpha", 3, 9, "File")]
    assert hits(spark, rows, Query(sort=Sort.NAME)) == ["/b/Alpha", "/c/alpha", "/a/beta"]
    assert hits(spark, rows, Query(sort=Sort.PATH)) == ["/a/beta", "/b/Alpha", "/c/alpha"]
    assert hits(spark, rows, Query(sort=Sort.SIZE)) == ["/c/alpha", "/a/beta", "/b/Alpha"]


def test_unicode_names(spark):
    rows = [("/x/报告.txt", 0), ("/x/تقرير.pdf", 0), ("/x/रिपोर्ट.doc", 0), ("/x/ΑΣ", 0)]
    assert hits(spark, rows, "报告") == ["/x/报告.txt"] and hits(spark, rows, "تقرير") == ["/x/تقرير.pdf"] and hits(spark, rows, "रिपोर्ट") == ["/x/रिपोर्ट.doc"]


def test_pruning_never_changes_results(spark):
    table = trigram.blocked(generate.synthetic(spark, 3000)).cache()
    index = trigram.postings(table).cache()
    for text in ("needle", "item-0 ext:rs", "ab", "zzzz", "é", "", "a1 7f"):
        q = Query(parse(text).terms, parse(text).exts, limit=40)
        assert search.pruned_search(table, index, q).select("path").collect() == search.ranked(search.matches(table, q), q).select("path").collect()
    assert trigram.candidates(index, parse("needle00000bb7")).count() == 1
    table.unpersist(), index.unpersist()


def test_plans(spark):
    q = Query(("main",), kinds=("File",), limit=5)
    plan = search.search(generate.synthetic(spark, 100), q)[0]._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CollectMetrics" in plan and "Python" not in plan


def test_view(spark):
    rows = files(spark, [("/a/Report.pdf", 0), ("/report/x.txt", 0), ("/b/y", 0, 1, "Dir")])
    names = lambda df: sorted(r["path"] for r in df.collect())
    assert names(view.post_filter(rows, "report")) == ["/a/Report.pdf"] and names(view.post_filter(rows, "report", "path")) == ["/a/Report.pdf", "/report/x.txt"]
    assert names(view.post_filter(rows, "Report", "path", True)) == ["/a/Report.pdf"] and names(view.post_filter(rows, "ext:pdf report")) == []
    assert len(names(view.post_filter(rows, "  "))) == 3 and names(view.post_filter(rows, "(", regex=True)) == [] and names(view.post_filter(rows, r"^r.*\.PDF$", regex=True)) == ["/a/Report.pdf"]
    assert names(view.in_roots(rows, [])) == [] and names(view.in_roots(rows, ["/a/"])) == ["/a/Report.pdf"]
    assert view.choose_scope("/a/b", ["/a"]) == ["/a/b"] and view.choose_scope("/ab", ["/a"]) == ["/a"] == view.choose_scope(None, ["/a"])
    assert view.settings_roots(["/b/", "/a", "/a/", "rel"]) == ["/a", "/b"] and view.for_viewer(Query(), " ").limit == 0


def test_formats(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    size = lambda n: one(labels.format_size(F.lit(n)))
    assert [size(n) for n in (0, 1023, 1024, 2304, 1 << 20, 5 << 30, 3 << 40)] == ["0 B", "1023 B", "1.0 KB", "2.2 KB", "1.0 MB", "5.0 GB", "3.0 TB"]
    age = lambda n: one(labels.format_mtime(F.lit(1_000_000_000 - n), F.lit(1_000_000_000)))
    assert [age(n) for n in (5, 60, 7200, 86400 * 6, 86400 * 7, -50, 1_000_000_000)] == ["Just now", "1 min ago", "2 hr ago", "6 days ago", "2001-09-02", "Just now", "Unknown"]
    assert one(labels.shorten(F.lit("abcdef"), 3)) == "…ef" and one(labels.shorten(F.lit("abcdef"), 1)) == "…" and one(labels.format_count(F.lit(1234567))) == "1,234,567"
    assert one(labels.trigrams(F.lit("aé"))) == [int.from_bytes("aé".encode())] and one(labels.trigrams(F.lit("ab"))) == []


def test_schema(spark):
    assert check(as_files(spark.createDataFrame([("/x",)], "path string")), FILE_SCHEMA).first()["kind"] == "File"
    with pytest.raises(ValueError):
        check(spark.range(1), FILE_SCHEMA)
    with pytest.raises(ValueError):
        as_files(spark.range(1))
    assert generate.demo(spark).count() == 65
