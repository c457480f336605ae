"""The registered queries, each with the SQL that must give the same rows in DuckDB (none where SQL can't say it)."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metasearch import render, serve
from metasearch.checkpoints import shared_folder
from metasearch.fixtures import duck, event_buffers, load, table_records, tree_items
from metasearch.functions import hosts, labels, paths
from metasearch.operators import hierarchy, lanes, namespace, overlay, search, trigram, view
from metasearch.plans.query import MAX_RESULTS, MAX_ROOTS, MAX_TERMS, MAX_TEXT_BYTES, Query, Sort, parse, validate
from metasearch.schema import CHANGE_SCHEMA, FILE_COLUMNS, as_files
from metasearch.sources import generate, mounts, native, text
from metasearch.store import Reader, Store
from metasearch.streaming import changes as stream
from metasearch.streaming import events as kernel

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}
#: The moment that ages are told from, in tests against SQL.
NOW = 1_700_600_000


def register(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def queries() -> dict[str, Run]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    one = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else quoted(v)
    return f"(select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns}))"


# search

SAFE = r"(not contains(path, chr(0)) and (starts_with(path, '/') or regexp_matches(path, '^[A-Za-z]:[/\\]') or starts_with(path, '\\')) and not regexp_matches(path, '(^|[/\\])\.{1,2}($|[/\\])'))"
NAME, EXT = "split_part(path, '/', -1)", r"regexp_extract(split_part(path, '/', -1), '(?s)^.+\.([^.]+)$', 1)"
CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def under_sql(path: str, root: str, ci: bool) -> str:
    p = f"replace(lower({path}), '\\', '/')" if ci else path
    r = quoted(root.lower().replace("\\", "/") if ci else root)
    return f"(starts_with({p}, {r}) and ({p} = {r} or ends_with({r}, '/') or ends_with({r}, '\\') or substr({p}, length({r}) + 1, 1) in ('/', '\\')))"


def matches_sql(rows: str, q: Query) -> str:
    conditions, score = [SAFE], ["0"]
    if q.kinds:
        conditions.append(f"kind in ({', '.join(map(quoted, q.kinds))})")
    if q.filesystems:
        conditions.append(f"fs in ({', '.join(map(quoted, q.filesystems))})")
    if q.exts:
        conditions.append(f"translate({EXT}, {CASE}) in ({', '.join(map(quoted, q.exts))})")
    if q.min_size is not None:
        conditions.append(f"size >= {q.min_size}")
    if q.max_size is not None:
        conditions.append(f"size <= {q.max_size}")
    if q.under is not None:
        conditions.append(under_sql("path", q.under, True))
    if q.scope_roots:
        conditions.append("(" + " or ".join(under_sql("path", r, not q.scope_case_sensitive) for r in q.scope_roots) + ")")
    for term in q.terms:
        t, n = quoted(term), len(term.encode())
        conditions.append(f"contains(lower(path), {t})")
        score.append(f"case when contains(lower({NAME}), {t}) then case when starts_with(lower({NAME}), {t}) then 1048576 else 4096 end + case when strlen({NAME}) = {n} then 16777216 else 0 end + 256 - least(strlen(split_part(lower({NAME}), {t}, 1)), 255) else 64 end")
    return f"select *, cast(least({' + '.join(score)}, 4294967295) as bigint) as score from ({rows}) r where {' and '.join(conditions)}"


def search_sql(rows: str, q: Query) -> str:
    order = {Sort.RELEVANCE: "score desc, mtime desc, ", Sort.NAME: f"translate({NAME}, {CASE}), ", Sort.PATH: "", Sort.SIZE: "size desc, ", Sort.MTIME: "mtime desc, "}[q.sort]
    return f"select *, count(*) over () as matched from ({matches_sql(rows, q)}) m order by {order}path, native_id, source{f' limit {q.limit}' if q.limit else ''}"


def searches(name: str, fixture: str, query: Query) -> None:
    register(name, lambda s, d: search.counted(load(s, d, fixture), query), search_sql(duck(fixture), query))


for name_, fixture_, text_, limit_ in (
    ("search_relevance", "files_part", "red", 50), ("search_multi_term", "files_part", "red brand-1", 50), ("search_quoted_phrase", "files_part", '"red bolt" ext:rs,txt,so', 1000),
    ("search_exact_name", "files_orders", "order-7.csv", 20), ("search_path_only_hit", "files_part", "economy", 100), ("search_unlimited", "files_orders", "order-1", 0),
    ("search_flagship", "files_part", "red ext:rs,txt,so kind:file size:>256k", 50), ("search_short_term", "files_docs", "4", 30), ("search_repeated_term", "files_docs", "doc doc src1", 40), ("search_no_hit", "files_part", "nosuchterm", 10),
    ("filter_ext", "files_part", "ext:.rs,TXT", 0), ("filter_ext_none", "files_part", "ext:.", 0), ("filter_kind", "files_part", "kind:link,bogus", 0), ("filter_fs", "files_part", "fs:ext3,ntfs-3g,smb3", 0),
    ("filter_size_range", "files_part", "size:512k..1M", 0), ("filter_size_min", "files_part", "size:>1m", 0), ("filter_size_max", "files_part", "size:<300k", 0), ("filter_size_invalid", "files_docs", "size:1.5M kind:File doc-1", 25),
    ("filter_under", "files_part", r"under:\PARTS\brand-1", 0), ("filter_under_slash", "files_docs", "under:/corpus/src1/", 0),
):
    searches(name_, fixture_, replace(parse(text_), limit=limit_))
searches("filter_scope_ci", "files_part", Query(limit=0, scope_roots=("/PARTS/brand-1", r"\parts\Brand-25"), scope_case_sensitive=False))
searches("filter_scope_cs", "files_part", Query(limit=0, scope_roots=("/PARTS/brand-1", "/parts/Brand-25", "/parts/Brand-1/"), scope_case_sensitive=True))
for sort_ in (Sort.NAME, Sort.PATH, Sort.SIZE, Sort.MTIME):
    searches(f"sort_{sort_.value}", "files_part", Query(sort=sort_, limit=64))

BAD = ["relative/x", "/a/../b", r"C:\ok\file.txt", r"\\server\share\f", "C:no", "/a/./b", "/ends/..", "/ok/...", "/new\nline/.", "//host/share/x"]
BAD_SQL = values([(p, i) for i, p in enumerate(BAD)], "path, native_id")
register(
    "filter_safe_path",
    lambda s, d: load(s, d, "files_part").select("path", "native_id").unionByName(s.createDataFrame([(p, i) for i, p in enumerate(BAD)], "path string, native_id long")).select("path", "native_id", paths.safe("path").alias("safe")),
    f"select path, native_id, {SAFE} as safe from (select path, native_id from ({duck('files_part')}) p union all select path, cast(native_id as bigint) from {BAD_SQL} b) u",
)

# views

ALL_PART = f"select * from ({duck('files_part')}) a union all select * from ({duck('dirs_part')}) b"


def all_part(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "files_part").unionByName(load(s, d, "dirs_part"))


register("facet_files", lambda s, d: view.facet(all_part(s, d), "files"), f"select * from ({ALL_PART}) x where kind in ('File', 'Symlink')")
register("facet_folders", lambda s, d: view.facet(all_part(s, d), "folders"), f"select * from ({ALL_PART}) x where kind = 'Dir'")
LIMITED = Query(terms=("parts",), limit=200)
register("post_filter_name", lambda s, d: view.post_filter(search.ranked(search.matches(all_part(s, d), LIMITED), LIMITED), " Gizmo ").select(*FILE_COLUMNS, "score"), f"select * exclude (matched) from ({search_sql(ALL_PART, LIMITED)}) h where contains(lower({NAME}), 'gizmo')")
register("post_filter_path_case", lambda s, d: view.post_filter(search.ranked(search.matches(all_part(s, d), LIMITED), LIMITED), "Brand-1", "name_path", True).select(*FILE_COLUMNS, "score"), f"select * exclude (matched) from ({search_sql(ALL_PART, LIMITED)}) h where contains({NAME} || ' ' || path, 'Brand-1')")
register("post_filter_regex", lambda s, d: view.post_filter(search.ranked(search.matches(all_part(s, d), LIMITED), LIMITED), r"^(RED|blue) .*\.(rs|so)$", "name", regex=True).select(*FILE_COLUMNS, "score"), rf"select * exclude (matched) from ({search_sql(ALL_PART, LIMITED)}) h where regexp_matches({NAME}, '^(RED|blue) .*\.(rs|so)$', 'i')")
register("post_filter_bad_regex", lambda s, d: view.post_filter(load(s, d, "files_part"), "(", regex=True).select("path"), "select cast('' as varchar) as path where false")
register("scope_allowed", lambda s, d: load(s, d, "files_part").filter(view.allowed("path", ["/parts/Brand-1", "/parts/Brand-2/"])).select("path"), f"select path from ({duck('files_part')}) p where starts_with(path, '/parts/Brand-1/') or starts_with(path, '/parts/Brand-2/')")
register("selected_roots", lambda s, d: view.in_roots(load(s, d, "files_docs"), view.choose_scope("/corpus/src1/en", ["/corpus/src1", "/other"])).select("path"), f"select path from ({duck('files_docs')}) p where starts_with(path, '/corpus/src1/en/')")

# functions

ODD = ["/a//b/c.txt", r"C:\Users\Alex\report.txt", "C:/", "c:", r"\\server\share\team\plan.txt", "//server/share", "//server", "", "/", "//", "/.hidden", "/x/archive.tar.gz", "/x/trailing.", "rel/path.md", "/deep/a/b/c/d/e.PDF", "/x/.gitignore", "/é/ü.Txt", "/x/photo.jpeg", "/x/a.sheet.xlsx"]
ODD_SQL = values([(p,) for p in ODD], "path")
JOINED = "array_to_string(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda c: c <> ''), '/')"
NORMAL = f"case when starts_with(replace(path, '\\', '/'), '//') then '//' || {JOINED} when starts_with(replace(path, '\\', '/'), '/') then '/' || {JOINED} when regexp_matches(replace(path, '\\', '/'), '^[A-Za-z]:/') and length({JOINED}) = 2 then {JOINED} || '/' when {JOINED} = '' then '/' else {JOINED} end"


def normal_sql(rows: str) -> str:
    """Adds n (normalized), parts and up to the rows."""
    return f"(select *, list_filter(string_split(n, '/'), lambda c: c <> '') as parts, regexp_replace(n, '(?s)/[^/]*$', '') as up from (select *, {NORMAL} as n from ({rows}) r0) r1)"


VOLUME = "(regexp_matches(n, '^[A-Za-z]:/$') or (starts_with(n, '//') and len(parts) = 2))"
PARENT = f"case when n = '/' or {VOLUME} or not contains(n, '/') or up = '' then '/' when length(up) = 2 and ends_with(up, ':') then up || '/' else up end"
DISPLAY = f"case when n = '/' then 'Computer' when {VOLUME} then regexp_replace(n, '/+$', '') else split_part(n, '/', -1) end"


def ancestors_sql(n: str, parts: str) -> str:
    drive, share = f"regexp_matches({n}, '^[A-Za-z]:/')", f"starts_with({n}, '//')"
    step = f"case when {drive} and i = 1 then {parts}[1] || '/' when {drive} then array_to_string({parts}[1:i], '/') when {share} then '//' || array_to_string({parts}[1:i], '/') else '/' || array_to_string({parts}[1:i], '/') end"
    return f"list_concat(['/'], list_transform(range(case when {share} then 2 else 1 end, len({parts}) + 1), lambda i: {step}))"


def odd(s: SparkSession, d: str) -> DataFrame:
    more = load(s, d, "files_pages").select("path").unionByName(load(s, d, "files_part").select("path")).distinct()
    return s.createDataFrame([(p,) for p in ODD], "path string").unionByName(more)


ODD_ALL = f"select path from {ODD_SQL} o union all select * from (select path from ({duck('files_pages')}) p union select path from ({duck('files_part')}) q) m"


def fn(name: str, column: Callable[[], Column], sql: str, normal: bool = False) -> None:
    register(name, lambda s, d: odd(s, d).select("path", column().alias("value")), f"select path, {sql} as value from {normal_sql(ODD_ALL) if normal else f'({ODD_ALL})'} t")


fn("fn_name", lambda: paths.name("path"), NAME)
fn("fn_ext", lambda: paths.extension("path"), EXT)
fn("fn_normalize", lambda: paths.normalize("path"), "n", True)
fn("fn_parent", lambda: paths.parent("path"), PARENT, True)
fn("fn_display_name", lambda: paths.display_name("path"), DISPLAY, True)
fn("fn_ancestors", lambda: F.array_join(paths.ancestors("path"), "|"), f"array_to_string({ancestors_sql('n', 'parts')}, '|')", True)
fn("fn_under", lambda: paths.under("path", "/parts/Brand-1"), under_sql("path", "/parts/Brand-1", False))
fn("fn_under_ci", lambda: paths.under_ci("path", "c:/users"), under_sql("path", "c:/users", True))
fn("fn_in_root", lambda: paths.in_root("path", "C:/Users/"), "replace(path, '\\', '/') = 'C:/Users' or starts_with(replace(path, '\\', '/'), 'C:/Users/')")
fn("fn_same_path", lambda: paths.same_path("path", F.lit(r"c:\USERS\alex\report.txt/"), True), "regexp_replace(translate(replace(path, '\\', '/'), " + CASE + "), '/+$', '') = 'c:/users/alex/report.txt'")
fn("fn_drive_root", lambda: paths.is_drive_root("path"), "regexp_matches(path, '^[A-Za-z]:/$')")
fn("fn_find_ci", lambda: paths.find_ci(F.col("path"), F.lit("r")), "case when contains(lower(path), 'r') then cast(strlen(split_part(lower(path), 'r', 1)) as bigint) end")
fn("fn_badge", lambda: labels.type_badge(F.lit("File"), F.col("path")), f"case when {EXT} = '' then 'FILE' else translate(substr({EXT}, 1, 4), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') end")
fn("fn_category", lambda: labels.category(F.lit("File"), F.col("path")), "case " + " ".join(f"when translate({EXT}, {CASE}) in ({', '.join(map(quoted, v))}) then '{k}'" for k, v in labels.CATEGORIES.items()) + " else 'other' end")
fn("fn_shorten", lambda: labels.shorten(F.col("path"), 12), "case when length(path) <= 12 then path else '…' || right(path, 11) end")
fn("fn_trigram_count", lambda: F.size(labels.trigrams(F.translate("path", "éü", "eu"))).cast("long"), "cast(len(list_distinct(list_transform(range(1, greatest(length(path) - 1, 1)), lambda i: substr(lower(translate(path, 'éü', 'eu')), i, 3)))) as bigint)")
UNIT = "case " + " ".join(f"when b >= {1 << p} then printf('%.1f {u}', cast(round_even(cast(b as decimal(38, 10)) / {1 << p}, 1) as double))" for p, u in ((40, "TB"), (30, "GB"), (20, "MB"), (10, "KB"))) + " else b || ' B' end"
register("fn_format_size", lambda s, d: load(s, d, "files_part").selectExpr("native_id", "size * native_id as b").select("native_id", labels.format_size(F.col("b")).alias("value")), f"select native_id, {UNIT} as value from (select native_id, size * native_id as b from ({duck('files_part')}) p) q")
register("fn_format_count", lambda s, d: load(s, d, "files_part").select("native_id", labels.format_count(F.col("size") * 7).alias("value")), f"select native_id, format('{{:,}}', size * 7) as value from ({duck('files_part')}) p")
AGE = f"({NOW} - mtime)"
register(
    "fn_format_mtime", lambda s, d: load(s, d, "files_part").select("native_id", labels.format_mtime(F.col("mtime") * (F.col("native_id") % 9 != 0).cast("long"), F.lit(NOW)).alias("value")),
    f"select native_id, case when mtime <= 0 then 'Unknown' when {AGE} < 60 then 'Just now' when {AGE} < 3600 then ({AGE} // 60) || ' min ago' when {AGE} < 86400 then ({AGE} // 3600) || ' hr ago' when {AGE} < 604800 then ({AGE} // 86400) || ' days ago' else strftime(date '1970-01-01' + cast(mtime // 86400 as integer), '%Y-%m-%d') end as value from (select native_id, mtime * cast(native_id % 9 <> 0 as bigint) as mtime from ({duck('files_part')}) p) q",
)
register("fn_mode_kind", lambda s, d: s.range(0, 65536, 257).select("id", labels.mode_kind(F.col("id")).alias("value")), "select range as id, case range & 61440 when 32768 then 'File' when 16384 then 'Dir' when 40960 then 'Symlink' else 'Other' end as value from range(0, 65536, 257)")
FS = ["ext2", "ext4", "ntfs-3g", "fuseblk", "zfs", "btrfs", "nfs4", "fuse.sshfs", "xfs", "tmpfs", "9p"]
FS_CASE = "case when v in ('ext2', 'ext3', 'ext4') then 'ext4' when v in ('ntfs', 'ntfs3', 'ntfs-3g', 'fuseblk') then 'ntfs' when v in ('btrfs', 'zfs') then v when v in (" + ", ".join(map(quoted, labels.NETWORK)) + ") then 'net:' || v else v end"
register("fn_fs_label", lambda s, d: s.createDataFrame([(v,) for v in FS], "v string").select("v", labels.fs_label_of(F.col("v")).alias("label"), labels.is_local(labels.fs_label_of(F.col("v"))).alias("local")), f"select v, {FS_CASE} as label, {FS_CASE} in ('btrfs', 'ext4', 'ntfs', 'zfs') as local from {values([(v,) for v in FS], 'v')} t")
DEVICES = ["server:/export", "//win/share", "user@host:/path", "/dev/sda1", "tank/data", "host", "a@b@c:/x", "//"]
register("fn_network_host", lambda s, d: s.createDataFrame([(v,) for v in DEVICES], "v string").select("v", labels.network_host(F.col("v")).alias("host")), f"select v, nullif(regexp_extract(split_part(regexp_replace(v, '^(//)+', ''), '@', -1), '^[^:/]*'), '') as host from {values([(v,) for v in DEVICES], 'v')} t")
HOSTS = ["host", "user@host", "-oProxy", "u@-x", "[fe80::1]", "[abc]", "a b", "user@h@x", "", "a.b-c_d", "-u@h", "@h"]
register("fn_valid_host", lambda s, d: s.createDataFrame([(v,) for v in HOSTS], "v string").select("v", hosts.valid_host(F.col("v")).alias("ok")), r"select v, regexp_matches(v, '^([A-Za-z0-9._][A-Za-z0-9._-]*@)?([A-Za-z0-9._][A-Za-z0-9._-]*|\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\])$') as ok from " + values([(v,) for v in HOSTS], "v") + " t")
MACHINES = ["amd64", " X86_64 ", "x64", "arm64", "aarch64", "riscv64"]
register("fn_architecture", lambda s, d: s.createDataFrame([(v,) for v in MACHINES], "v string").select("v", hosts.architecture(F.col("v")).alias("arch")), "select v, case when lower(trim(v)) in ('amd64', 'x86_64', 'x64') then 'x86_64' when lower(trim(v)) in ('arm64', 'aarch64') then 'aarch64' else lower(trim(v)) end as arch from " + values([(v,) for v in MACHINES], "v") + " t")
ERRORS = ["ssh: Connection refused", "No route to host", "permission denied", "x: Name or service not known"]
register("offline_errors", lambda s, d: s.createDataFrame([(v,) for v in ERRORS], "v string").select("v", hosts.is_offline(F.col("v")).alias("offline")), "select v, " + " or ".join(f"contains(lower(v), {quoted(p)})" for p in hosts.OFFLINE) + " as offline from " + values([(v,) for v in ERRORS], "v") + " t")
register("fn_checksum", lambda s, d: load(s, d, "files_part").select("native_id", F.sha2("path", 256).alias("sha"), hosts.artifact_matches(F.col("path").cast("binary"), F.concat(F.sha2("path", 256), F.lit("  x"))).alias("ok")), f"select native_id, sha256(path) as sha, true as ok from ({duck('files_part')}) p")

# trigrams

GRAMS = "select path, unnest(list_distinct(list_transform(range(1, length(path) - 1), lambda i: cast(ord(substr(lower(path), i, 1)) * 65536 + ord(substr(lower(path), i + 1, 1)) * 256 + ord(substr(lower(path), i + 2, 1)) as bigint)))) as gram"
register("trigram_postings", lambda s, d: trigram.postings(load(s, d, "files_part").withColumn("block_id", F.col("native_id"))), f"select distinct gram, block_id from (select native_id as block_id, g.gram from ({GRAMS}, native_id from ({duck('files_part')}) p) g) x")
PRUNED = replace(parse("gizmo brand-1 kind:file"), limit=80)
register("trigram_candidates", lambda s, d: trigram.candidates(trigram.postings(load(s, d, "files_part").withColumn("block_id", F.floor(F.col("native_id") / 8))), PRUNED),
         f"select block_id from (select distinct native_id // 8 as block_id, gram from ({GRAMS}, native_id from ({duck('files_part')}) p) g) x where gram in ({', '.join(map(str, sorted(set().union(*map(trigram.grams_of, PRUNED.terms)))))}) group by block_id having count(*) = {len(set().union(*map(trigram.grams_of, PRUNED.terms)))}")


def pruned(s: SparkSession, d: str, query: Query) -> DataFrame:
    files = trigram.blocked(load(s, d, "files_part"))
    return search.pruned_search(files, trigram.postings(files), query).select(*FILE_COLUMNS, "score")


register("search_trigram_pruned", lambda s, d: pruned(s, d, PRUNED), f"select * exclude (matched) from ({search_sql(duck('files_part'), PRUNED)}) x")
register("search_trigram_missing", lambda s, d: pruned(s, d, replace(parse("qqqzzz"), limit=10)), f"select * exclude (matched) from ({search_sql(duck('files_part'), replace(parse('qqqzzz'), limit=10))}) x")
register("search_trigram_short", lambda s, d: pruned(s, d, replace(parse("re"), limit=10)), f"select * exclude (matched) from ({search_sql(duck('files_part'), replace(parse('re'), limit=10))}) x")

# overlay

FOLD = f"select * exclude (rn) from (select *, row_number() over (partition by path order by seq desc, op desc) as rn from ({duck('changes_events')}) c) f where rn = 1"
LIVE = f"select path, size, mtime, mode, kind, fs, native_id, native_parent, source from ({duck('files_part')}) b where path not in (select path from ({FOLD}) f) union all select path, size, mtime, 0, 'File', 'ext4', 0, 0, 0 from ({FOLD}) f where op = 'Upsert'"


def events(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "changes_events")


def live(s: SparkSession, d: str) -> DataFrame:
    return overlay.overlay(load(s, d, "files_part"), events(s, d))


register("delta_fold", lambda s, d: overlay.fold(events(s, d)).select("seq", "batch_id", "op", "path", "size", "mtime"), FOLD)
register("overlay_live", live, LIVE)
OVER = replace(parse("red .new"), limit=30)
register("overlay_search", lambda s, d: search.counted(live(s, d), OVER), search_sql(LIVE, OVER))
register("overlay_counts", lambda s, d: overlay.counts(load(s, d, "files_part"), events(s, d)), f"select b.n as base_rows, f.u as upserts, f.r as removes, b.n + f.u + f.r as scanned from (select count(*) as n from ({duck('files_part')}) p) b, (select count(*) filter (op = 'Upsert') as u, count(*) filter (op = 'Remove') as r from ({FOLD}) f) f")
register("source_drop", lambda s, d: overlay.drop_source(load(s, d, "files_part"), 1), f"select * from ({duck('files_part')}) p where source <> 1")
register("source_drop_count", lambda s, d: overlay.dropped_count(load(s, d, "files_part"), 1), f"select count(*) filter (source = 1) as removed from ({duck('files_part')}) p")
register("batch_append", lambda s, d: overlay.append(load(s, d, "files_part"), load(s, d, "files_docs")), f"select * from ({duck('files_part')}) p union all select * from ({duck('files_docs')}) q")
register("invalid_changes", lambda s, d: overlay.invalid_changes(events(s, d).select(F.concat(F.when(F.col("seq") % 5 == 0, F.lit("x")).otherwise(F.lit("")), F.col("path"), F.when(F.col("seq") % 7 == 0, F.lit("/..")).otherwise(F.lit(""))).alias("path"), "seq")).select("seq"), f"select seq from ({duck('changes_events')}) c where seq % 5 = 0 or seq % 7 = 0")

# lanes

register("scan_totals", lambda s, d: lanes.scan_totals(all_part(s, d)), f"select fs, count(*) as records, count(*) filter (kind = 'Dir') as dirs, count(*) filter (kind <> 'Dir') as files from ({ALL_PART}) x group by fs")
LANES = [("index: /", True), ("/home", False), ("/mnt", True)]
register("lane_success", lambda s, d: lanes.lane_success(s.createDataFrame(LANES, "label string, error boolean")), f"select count(*) as mounts, count(*) filter (error) as errors, count(*) > 0 and count(*) filter (error) < count(*) as publish from {values(LANES, 'label, error')} t")
register("runtime_state", lambda s, d: lanes.runtime_state(s.createDataFrame(LANES, "label string, error boolean"), F.lit(True), F.lit(False), F.lit(True)), f"select case when bool_or(error and (contains(label, 'index') or contains(label, 'cache'))) then 'Stale' when bool_or(error) then 'Permission' else 'Ready' end as state from {values(LANES, 'label, error')} t")

# namespaces

TREE = duck("inode_tree")


def tree(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "inode_tree")


def walk_sql(rows: str, root: int, check: str = "") -> str:
    return f"with recursive t as ({rows}), w as (select id, parent, sequence, name, is_dir, size, '/' || name as path from t where parent = {root} and id <> {root}{' and parent_seq = 0' if check else ''} union all select t.id, t.parent, t.sequence, t.name, t.is_dir, t.size, w.path || '/' || t.name from t join w on t.parent = w.id and w.is_dir and t.id <> {root}{check}) select id, parent, path, is_dir, size from w"


SEQUENCE = " and (t.parent_seq = 0 or t.parent_seq = w.sequence)"
SHOWN = ["id", "parent", "path", "is_dir", "size"]
register("namespace_paths", lambda s, d: namespace.inode_paths(tree(s, d), check_sequence=False).select(*SHOWN), walk_sql(TREE, 5))
register("namespace_sequence_check", lambda s, d: namespace.inode_paths(tree(s, d)).select(*SHOWN), walk_sql(TREE, 5, SEQUENCE))
CYCLE = [(900001, 900002, 0, 1, "a", True, 1), (900002, 900001, 0, 1, "b", True, 1), (900003, 900001, 0, 1, "c.txt", False, 1), (900004, 777777777, 0, 1, "orphan", True, 1), (900005, 900005, 0, 1, "self", True, 1), (900006, 12, 0, 1, "ok", True, 1), (900007, 900006, 0, 1, "in.txt", False, 3)]
INODE = "id bigint, parent bigint, parent_seq bigint, sequence bigint, name string, is_dir boolean, size bigint"
CYCLES = f"{TREE} union all select * from {values(CYCLE, 'id, parent, parent_seq, sequence, name, is_dir, size')} c"
register("namespace_cycles", lambda s, d: namespace.inode_paths(tree(s, d).unionByName(s.createDataFrame(CYCLE, INODE))).select(*SHOWN), walk_sql(CYCLES, 5, SEQUENCE))
register("namespace_records", lambda s, d: namespace.as_records(namespace.inode_paths(tree(s, d), prefix="C:\\").withColumn("mtime", F.lit(0)), "ntfs"), f"select 'C:' || path as path, size, cast(0 as bigint) as mtime, cast(0 as bigint) as mode, case when is_dir then 'Dir' else 'File' end as kind, 'ntfs' as fs, id as native_id, parent as native_parent, cast(0 as bigint) as source from ({walk_sql(TREE, 5, SEQUENCE)}) w")
LINKS = "select parent, id, name, id as ord from t union all select 10, id, 'again-' || name, id + 1000000000 from t where id % 3 = 0 and not is_dir union all select 11, id, 'dir-' || name, id + 2000000000 from t where is_dir and id between 100 and 110"


def linked(s: SparkSession, d: str) -> DataFrame:
    inodes = tree(s, d)
    more = inodes.filter("id % 3 = 0 and not is_dir").selectExpr("cast(10 as bigint) parent", "id", "concat('again-', name) name", "id + 1000000000 as ord")
    dirs = inodes.filter("is_dir and id between 100 and 110").selectExpr("cast(11 as bigint) parent", "id", "concat('dir-', name) name", "id + 2000000000 as ord")
    links = inodes.selectExpr("parent", "id", "name", "id as ord").unionByName(more).unionByName(dirs)
    return namespace.linked_paths(links, inodes.select("id", "is_dir", "size"), 5).select("parent", "id", "path")


register(
    "namespace_hardlinks", linked,
    f"with recursive t as ({TREE}), l as ({LINKS}), d as (select id, '' as path, 0 as depth, [0] as way from (select 5 as id) r union all select l.id, d.path || '/' || l.name, d.depth + 1, list_append(d.way, l.ord) from l join d on l.parent = d.id join t on t.id = l.id and t.is_dir where d.depth < 6), "
    "o as (select * from (select *, row_number() over (partition by id order by depth, way) as rn from d) x where rn = 1) select l.parent, l.id, case when o.path = '' then '' else o.path end || '/' || l.name as path from l join o on l.parent = o.id join t on t.id = l.id",
)
NAMES_SQL = f"select id, parent, name, cast(case id % 4 when 0 then 2 when 1 then 1 when 2 then 0 else 3 end as bigint) as namespace, cast(1 as bigint) as ord from ({TREE}) t union all select id, parent, upper(left(name, 4)) || '~1', cast(case id % 3 when 0 then 2 else 3 end as bigint), cast(2 as bigint) from ({TREE}) t union all select id, 10, 'other-' || name, cast(0 as bigint), cast(3 as bigint) from ({TREE}) t where id % 5 = 0"


def names(s: SparkSession, d: str) -> DataFrame:
    t = tree(s, d)
    a = t.selectExpr("id", "parent", "name", "cast(case id % 4 when 0 then 2 when 1 then 1 when 2 then 0 else 3 end as bigint) namespace", "cast(1 as bigint) ord")
    b = t.selectExpr("id", "parent", "concat(upper(left(name, 4)), '~1') name", "cast(case id % 3 when 0 then 2 else 3 end as bigint) namespace", "cast(2 as bigint) ord")
    c = t.filter("id % 5 = 0").selectExpr("id", "cast(10 as bigint) parent", "concat('other-', name) name", "cast(0 as bigint) namespace", "cast(3 as bigint) ord")
    return a.unionByName(b).unionByName(c)


RANK = "case namespace when 1 then 3 when 3 then 3 when 0 then 2 when 2 then 1 else 0 end"
BEST = f"select id, parent, name from (select *, row_number() over (partition by id order by {RANK} desc, ord) as rn from ({NAMES_SQL}) n) x where rn = 1"
register("ntfs_best_name", lambda s, d: namespace.best_names(names(s, d)), BEST)
register("ntfs_extra_names", lambda s, d: namespace.extra_names(names(s, d)), f"select distinct id, parent, name from ({NAMES_SQL}) n where namespace <> 2 except select * from ({BEST}) b")
register("btrfs_first_link", lambda s, d: namespace.first_links(names(s, d)), f"select id, parent, name from (select *, row_number() over (partition by id order by ord) as rn from ({NAMES_SQL}) n) x where rn = 1")
RECORDS = f"select id, sequence, size, cast(case when id % 4 = 3 then id - 1 else 0 end as bigint) as base_id, cast(id % 3 as bigint) as base_seq from ({TREE}) t"
register("ntfs_extension_merge", lambda s, d: namespace.merge_extensions(tree(s, d).selectExpr("id", "sequence", "size", "cast(case when id % 4 = 3 then id - 1 else 0 end as bigint) base_id", "cast(id % 3 as bigint) base_seq")), f"select b.id, b.sequence, greatest(b.size, coalesce(max(e.size), 0)) as size from ({RECORDS}) b left join ({RECORDS}) e on e.base_id = b.id and (e.base_seq = 0 or e.base_seq = b.sequence) where b.base_id = 0 group by b.id, b.sequence, b.size")
ALIASES = f"select id, cast(10 as bigint) as parent, 'alias-' || name as name from ({TREE}) t where id % 2 = 0"
register("ntfs_alias_paths", lambda s, d: namespace.alias_paths(tree(s, d).filter("id % 2 = 0").selectExpr("id", "cast(10 as bigint) parent", "concat('alias-', name) name"), tree(s, d)).select("id", "path"), f"select a.id, '/AFRICA/' || a.name as path from ({ALIASES}) a join ({TREE}) t on t.id = a.id and not t.is_dir")

# folders


PLACED = lambda rows: f"(select *, {PARENT} as parent from {normal_sql(rows)} z)"
DIRECT = lambda rows: f"select parent as folder, cast(sum(greatest(size, 1)) as bigint) as bytes, count(*) as count from {PLACED(rows)} p where kind <> 'Dir' group by parent"
SPLIT = "list_filter(string_split({0}, '/'), lambda c: c <> '')"
FOLDERS = lambda rows: f"(select distinct folder from (select unnest({ancestors_sql('parent', SPLIT.format('parent'))}) as folder from (select distinct parent from {PLACED(rows)} p) q union all select n from {PLACED(rows)} p where kind = 'Dir' union all select '/') u)"
ROLLUP = lambda rows: f"select f.folder, cast(coalesce(sum(x.bytes), 0) as bigint) as bytes, cast(coalesce(sum(x.count), 0) as bigint) as count from {FOLDERS(rows)} f left join (select unnest({ancestors_sql('folder', SPLIT.format('folder'))}) as folder, bytes, count from ({DIRECT(rows)}) e) x on x.folder = f.folder group by f.folder"
CHILDREN = lambda rows: f"select distinct parent, child from (select a[i] as parent, a[i + 1] as child from (select a, unnest(range(1, len(a))) as i from (select {ancestors_sql('parent', SPLIT.format('parent'))} as a from (select distinct parent from {PLACED(rows)} p) q) r) s union all select parent, n from {PLACED(rows)} p where kind = 'Dir') u"
DOCS_PAGES = f"select * from ({duck('files_docs')}) a union all select * from ({duck('files_pages')}) b union all select * from ({duck('dirs_part')}) c"


def mixed(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "files_docs").unionByName(load(s, d, "files_pages")).unionByName(load(s, d, "dirs_part"))


register("folder_direct", lambda s, d: hierarchy.direct(mixed(s, d)), DIRECT(DOCS_PAGES))
register("folder_rollup", lambda s, d: hierarchy.rollup(mixed(s, d)), ROLLUP(DOCS_PAGES))
register("folder_children", lambda s, d: hierarchy.children(mixed(s, d)), CHILDREN(DOCS_PAGES))


def tiles_sql(rows: str, folder: str) -> str:
    f = quoted(folder)
    dirs = f"select path, {DISPLAY} as name, greatest(bytes, 1) as bytes, count, true as folder, '' as extension from {normal_sql(f'select folder as path, bytes, count from ({ROLLUP(rows)}) r where folder in (select child from ({CHILDREN(rows)}) c where parent = {f})')} d"
    direct = f"select path, display as name, greatest(size, 1) as bytes, cast(1 as bigint) as count, false as folder, case when contains(display, '.') then lower(split_part(display, '.', -1)) else '' end as extension from (select *, {DISPLAY} as display from {PLACED(rows)} p where kind <> 'Dir' and parent = {f}) e"
    return f"select * from (select * from ({dirs}) a union all select * from ({direct}) b) t order by bytes desc, path, folder limit 256"


register("treemap_blocks", lambda s, d: hierarchy.tiles(mixed(s, d), "/corpus/src1/en"), tiles_sql(DOCS_PAGES, "/corpus/src1/en"))
register("treemap_root", lambda s, d: hierarchy.tiles(mixed(s, d), "/"), tiles_sql(DOCS_PAGES, "/"))

# operating system text

MOUNTINFO = [
    "36 35 98:0 / / rw,noatime - ext4 /dev/sda1 rw", "37 36 0:3 / /proc rw - proc proc rw", "38 36 0:40 / /home rw shared:1 - btrfs /dev/sdb1 rw", "39 36 0:41 / /mnt/my\\040disk rw - fuseblk /dev/sdc1 rw",
    "40 36 0:42 / /net/a rw - nfs4 server:/export rw", "41 36 0:43 / /net/b rw - cifs //win/share rw", "42 36 0:44 / /net/c rw - sshfs :/x rw", "short line", "43 36 0:45 / /data rw - zfs tank/data rw",
]
MOUNTED = [("/dev/sda1", "/", "ext4", "Local", None), ("/dev/sdb1", "/home", "btrfs", "Local", None), ("/dev/sdc1", "/mnt/my disk", "ntfs", "Local", None), ("server:/export", "/net/a", "net:nfs4", "Remote", "server"), ("//win/share", "/net/b", "net:cifs", "Remote", "win"), ("tank/data", "/data", "zfs", "Local", None)]


def lines(s: SparkSession, rows: list[str]) -> DataFrame:
    return s.createDataFrame([(r,) for r in rows], "value string")


def mounted(s: SparkSession) -> DataFrame:
    return text.mountinfo(lines(s, MOUNTINFO))


MOUNT_SQL = (
    "(select device, mountpoint, fs, case when starts_with(fs, 'net:') then 'Remote' else 'Local' end as source_kind, host from (select device, mountpoint, " + FS_CASE + " as fs, case when " + FS_CASE + " like 'net:%' then nullif(regexp_extract(split_part(regexp_replace(device, '^(//)+', ''), '@', -1), '^[^:/]*'), '') end as host, v from "
    "(select replace(string_split(post, ' ')[2], '\\040', ' ') as device, replace(string_split(pre, ' ')[5], '\\040', ' ') as mountpoint, string_split(post, ' ')[1] as v from (select split_part(value, ' - ', 1) as pre, split_part(value, ' - ', 2) as post from " + values([(r,) for r in MOUNTINFO], "value") + " l where contains(value, ' - ')) a) b "
    "where v in (" + ", ".join(map(quoted, [*labels.FILESYSTEMS, *labels.NETWORK])) + ")) c where not starts_with(fs, 'net:') or host is not null)"
)
register("mounts_parse", lambda s, d: mounted(s), f"select device, mountpoint, fs, source_kind, host from {MOUNT_SQL} m")
ROOTS = ["/home/u/x", "/mnt/my disk", "/net/a/b", "/etc", "/homework", "/data/z"]
register("mounts_for_roots", lambda s, d: mounts.mounts_for_roots(s.createDataFrame([(r,) for r in ROOTS], "root string"), mounted(s)), f"select root, mountpoint, fs from (select *, row_number() over (partition by root order by strlen(mountpoint) desc, mountpoint desc) as n from {values([(r,) for r in ROOTS], 'root')} r join {MOUNT_SQL} m on root = mountpoint or starts_with(root, rtrim(mountpoint, '/') || '/')) x where n = 1 and fs in ('btrfs', 'ext4', 'ntfs', 'zfs')")
register("mounts_resolve", lambda s, d: mounts.resolve(s.createDataFrame([("/home",), ("/",), ("/home",)], "mountpoint string"), mounted(s)), f"select * from {MOUNT_SQL} m where mountpoint in ('/home', '/')")
register("new_network_mounts", lambda s, d: mounts.new_network_mounts(mounted(s), s.createDataFrame([("server:/export:/net/a",)], "identity string")), f"select device || ':' || mountpoint as identity, * from {MOUNT_SQL} m where source_kind = 'Remote' and mountpoint <> '/net/a'")
MAC = ["/dev/disk1s1 on / (apfs, local, journaled)", "/dev/disk1s2 on /System/Volumes/VM (apfs, local)", "map auto_home on /home (autofs)", "/dev/disk2 on /Volumes/My Disk (1) (hfs)"]
register("mac_mounts", lambda s, d: text.mac_mounts(lines(s, MAC)), f"select device, mountpoint, fs from (select regexp_extract(value, '^(.*?) on (.*) \\(([^()]*)\\)*$', 1) as device, regexp_extract(value, '^(.*?) on (.*) \\(([^()]*)\\)*$', 2) as mountpoint, trim(split_part(regexp_extract(value, '^(.*?) on (.*) \\(([^()]*)\\)*$', 3), ',', 1)) as fs from {values([(m,) for m in MAC], 'value')} t) x where fs in ('apfs', 'hfs') and not starts_with(mountpoint, '/System/Volumes/')")
DIFF = ["+\t/tank/new", "-\t/tank/old", "M\t/\t/tank/typed", "R\tF\t/tank/a\t/tank/b", "", "M\t/tank/plain"]
register("zfs_diff_parse", lambda s, d: text.zfs_diff(s.createDataFrame(list(enumerate(DIFF, 1)), "line long, value string")), f"select line, case string_split(value, chr(9))[1] when '+' then 'Created' when '-' then 'Removed' when 'M' then 'Modified' else 'Renamed' end as change, string_split(value, chr(9))[case when len(string_split(value, chr(9))) >= 3 then 3 else 2 end] as path, case when string_split(value, chr(9))[1] = 'R' then string_split(value, chr(9))[4] end as to_path from {values(list(enumerate(DIFF, 1)), 'line, value')} t where value <> ''")
register("zfs_changes", lambda s, d: text.zfs_changes(text.zfs_diff(s.createDataFrame(list(enumerate(DIFF, 1)), "line long, value string"))), f"select line, case when change in ('Removed', 'Renamed') then 'Remove' else 'Upsert' end as op, path from ({SQL['zfs_diff_parse']}) p union all select line, 'Upsert', to_path from ({SQL['zfs_diff_parse']}) q where change = 'Renamed'")
register("mdfind_parse", lambda s, d: text.split_nul(lines(s, ["/A/a file\0/A/with\nnewline\0", "\0\0/B"])), "select path from (select unnest(string_split(value, chr(0))) as path from (select '/A/a file' || chr(0) || '/A/with' || chr(10) || 'newline' || chr(0) as value union all select chr(0) || chr(0) || '/B') v) t where path <> ''")
KEPT = ["/.snapshots/42/file", "/.snapshots-old/file", "/proc/self/status", "/processes", "/home/system/file", "/sys", "/system"]
register("default_exclusions", lambda s, d: s.createDataFrame([(k,) for k in KEPT], "path string").select("path", mounts.excluded("path", "/").alias("root"), mounts.excluded("path", "/home").alias("home")), f"select path, path in ('/proc', '/sys', '/.snapshots') or starts_with(path, '/proc/') or starts_with(path, '/sys/') or starts_with(path, '/.snapshots/') as root, path = '/home/.snapshots' or starts_with(path, '/home/.snapshots/') as home from {values([(k,) for k in KEPT], 'path')} t")
register("scan_roots_filter", lambda s, d: mounts.scanned(load(s, d, "files_part"), "/", ["/parts/Brand-1/", "/parts/Brand-11"]), f"select * from ({duck('files_part')}) p where starts_with(path, '/parts/Brand-1/') or starts_with(path, '/parts/Brand-11/')")
register("scan_roots_join", lambda s, d: mounts.scanned_by(load(s, d, "files_part"), load(s, d, "dirs_part").filter("path like '%/PROMO'").select(F.col("path").alias("root"))), f"select * from ({duck('files_part')}) p where contains(path, '/PROMO/')")
register("watch_exclusions", lambda s, d: load(s, d, "files_docs").select("path", mounts.watch_excluded("path", "/corpus/src1", ["/corpus/src1/en/doc-1.txt"]).alias("excluded")), f"select path, not starts_with(path, '/corpus/src1/') or path = '/corpus/src1/en/doc-1.txt' as excluded from ({duck('files_docs')}) p")

# responses

SHORT = replace(parse("red"), limit=5)
JSON = f"select to_json({{'paths': list(path order by score desc, mtime desc, path), 'matched': any_value(matched), 'returned': count(*), 'search_us': cast(0 as bigint), 'records': list({{'path': path, 'kind': lower(kind), 'size': size, 'mtime': mtime, 'fs': fs}} order by score desc, mtime desc, path)}}) as response from ({search_sql(duck('files_part'), SHORT)}) h"
register("response_json", lambda s, d: render.response_json(load(s, d, "files_part"), SHORT, metadata=True), JSON)
register("response_tsv", lambda s, d: render.response_text(load(s, d, "files_part"), SHORT, metadata=True), f"select '# matched=' || any_value(matched) || ' returned=' || count(*) || ' search_us=0' || chr(10) || string_agg(path || chr(9) || kind || chr(9) || size || chr(9) || mtime || chr(9) || fs, chr(10) order by score desc, mtime desc, path) as response from ({search_sql(duck('files_part'), SHORT)}) h")

# stores and streams


def new_store(s: SparkSession) -> Store:
    """A store in a folder that the whole cluster sees."""
    return Store(s, f"{shared_folder(s).rstrip('/')}/store-{uuid.uuid4().hex}")


def stored(s: SparkSession, d: str) -> DataFrame:
    store = new_store(s)
    store.build(load(s, d, "files_part"))
    return store.files()


def full_changes(s: SparkSession, d: str) -> DataFrame:
    c, have = events(s, d), {"seq", "batch_id", "op", "path", "size", "mtime"}
    from metasearch.schema import DEFAULTS

    return c.select(*[(F.col(f.name) if f.name in have else F.lit(DEFAULTS[f.name])).cast(f.dataType).alias(f.name) for f in CHANGE_SCHEMA])


def compacted(s: SparkSession, d: str) -> DataFrame:
    store = new_store(s)
    store.build(load(s, d, "files_part"))
    changes = full_changes(s, d)
    for batch in range(3):
        store.apply(batch, changes.filter(F.floor(F.col("seq") / 100) % 3 == batch))
    store.compact()
    return store.files()


def streamed(s: SparkSession, d: str) -> DataFrame:
    store = new_store(s)
    store.build(load(s, d, "files_part"))
    changes = full_changes(s, d)
    changes.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{store.root}-in")
    query = stream.follow(stream.read_changes(s, f"{store.root}-in", 2), store, f"{store.root}-progress")
    query.awaitTermination()
    return store.files()


def status(s: SparkSession, d: str) -> DataFrame:
    store = new_store(s)
    store.build(load(s, d, "files_part"))
    store.apply(0, full_changes(s, d))
    m = store.manifest()
    return s.createDataFrame([(m.records, m.changes, m.generation)], "records long, changes long, generation long")


EVENTS = [
    (1, ["CREATE"], "Current", True, True, "/a"), (2, ["DELETE"], "Current", True, False, "/a"), (3, ["RENAME"], "Old", True, False, "/b"), (4, ["RENAME"], "New", True, True, "/c"),
    (5, ["CLOSE_WRITE"], "Object", False, True, "/d"), (6, ["CREATE"], "Current", True, False, "/e"), (7, ["OPEN"], "Current", True, True, "/f"), (8, ["MOVED_TO"], "Current", True, True, "/g"), (9, ["CREATE"], "Object", False, True, "/h"),
]
EVENT = "seq long, mask array<string>, role string, named boolean, present boolean, path string"
register("store_roundtrip", stored, duck("files_part"))
register("store_compaction", compacted, LIVE)
register("stream_apply", streamed, LIVE)
register("index_status", status, f"select (select count(*) from ({duck('files_part')}) p) as records, (select count(*) from ({FOLD}) f) as changes, cast(1 as bigint) as generation")
MASKED = values([(n, "|".join(m), *rest) for n, m, *rest in EVENTS], "seq, masks, role, named, present, path")
ANY = lambda types: f"list_has_any(string_split(masks, '|'), [{', '.join(map(quoted, types))}])"
OPS = f"case when named and (role = 'Old' or role = 'Current' and {ANY(stream.REMOVES)}) then 'Remove' when named and (role = 'New' or {ANY(stream.UPSERTS)}) then case when present then 'Upsert' else 'Remove' end when not named and role = 'Object' and {ANY(['ATTRIB', 'CLOSE_WRITE'])} and present then 'Upsert' end"
register("stream_events", lambda s, d: stream.batch_changes(s.createDataFrame(EVENTS, EVENT)).select("seq", "op", "path"),
         f"select seq, op, path from (select *, row_number() over (partition by path order by seq desc, op desc) as n from (select *, {OPS} as op from {MASKED} e) o where op is not null) x where n = 1")
RESCANS = {"quiet": [["CREATE"]], "full": [["Q_OVERFLOW"]], "folder": [["ONDIR", "RENAME"]], "unpaired": [["MOVED_FROM"]]}
register("stream_rescan", lambda s, d: s.createDataFrame([(k, stream.rescan_reason(s.createDataFrame([(m,) for m in v], "mask array<string>"), False)) for k, v in RESCANS.items()], "batch string, reason string"),
         f"select batch, case when {ANY(['Q_OVERFLOW'])} then 'the event queue overflowed' when {ANY(['ONDIR'])} and {ANY([*stream.MOVES, 'RENAME'])} then 'a directory was renamed' when {ANY(stream.MOVES)} then 'a move came without its other side' end as reason from {values([(k, '|'.join(v[0])) for k, v in RESCANS.items()], 'batch, masks')} t")
register("needle", lambda s, d: search.counted(generate.synthetic(s, 200_000), replace(parse(f"needle{199_999:08x}"), limit=10)).select("score", "matched", "native_id"), "select cast(1048832 as bigint) as score, cast(1 as bigint) as matched, cast(199999 as bigint) as native_id")
register("demo_table", lambda s, d: as_files(generate.demo(s)).agg(F.count(F.lit(1)).alias("n")), "select cast(65 as bigint) as n")


# order, and what the store reads back


def placed(rows: DataFrame) -> DataFrame:
    """The rows with their place: the order is part of the result."""
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    return numbered.withColumn("place", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


PLACES = f"select *, row_number() over (order by path, native_id) as place from ({duck('files_part')}) p"
register("files_sorted", lambda s, d: placed(load(s, d, "files_part").orderBy("path", "native_id")), PLACES)


def records(s: SparkSession, d: str) -> DataFrame:
    store = new_store(s)
    store.build(load(s, d, "files_part").repartition(3))
    return placed(store.records())


register("store_records", records, PLACES)


def read(s: SparkSession, d: str, query: Query, changed: bool) -> DataFrame:
    """A search through a reader of a stored catalog: by its index, with the changes since."""
    store = new_store(s)
    store.build(load(s, d, "files_part"))
    if changed:
        store.apply(0, full_changes(s, d))
    return search.counted(Reader(store).rows(query), query)


INDEXED, NOT_FOUND = replace(parse("gizmo brand-1"), limit=40), replace(parse("qqqzzz"), limit=5)
register("reader_search", lambda s, d: read(s, d, INDEXED, False), search_sql(duck("files_part"), INDEXED))
register("reader_search_changed", lambda s, d: read(s, d, OVER, True), search_sql(LIVE, OVER))
register("reader_no_hit", lambda s, d: read(s, d, NOT_FOUND, True), search_sql(LIVE, NOT_FOUND))
register("reader_short_term", lambda s, d: read(s, d, replace(parse("re"), limit=10), False), search_sql(duck("files_part"), replace(parse("re"), limit=10)))


def published(s: SparkSession, d: str) -> DataFrame:
    """Some lanes failed: what the others found is published. Then all fail: the catalog stays."""
    store = new_store(s)
    store.publish(load(s, d, "files_part").filter("source <> 2"), 3, 1)
    store.publish(load(s, d, "files_part"), 3, 3)
    return store.files()


register("store_publish", published, f"select * from ({duck('files_part')}) p where source <> 2")


def statistics(s: SparkSession, d: str) -> DataFrame:
    store = new_store(s)
    store.build(load(s, d, "files_part"))
    got = store.status()
    return s.createDataFrame([(got["records"], got["trigrams"], got["blocks"] > 0 and got["build_ms"] > 0 and got["bytes"] > 0, got["store"])], "records long, trigrams long, measured boolean, store string")


register("index_statistics", statistics, f"select (select count(*) from ({duck('files_part')}) p) as records, (select count(distinct gram) from ({GRAMS} from ({duck('files_part')}) p) g) as trigrams, true as measured, 'base' as store")


def asked(s: SparkSession, d: str) -> Reader:
    store = new_store(s)
    store.build(load(s, d, "files_part"))
    return Reader(store)


def line_answers(s: SparkSession, d: str) -> DataFrame:
    out = io.StringIO()
    serve.line_server(asked(s, d), [json.dumps({"query": "red brand-1", "limit": 7, "metadata": True, "scopes": ["/parts"]}), json.dumps({"query": "x", "scopes": ["relative"]})], out)
    first, second = map(json.loads, out.getvalue().splitlines())
    return s.createDataFrame([(i, p, r["kind"], r["size"], first["matched"], first["returned"], "error" in second) for i, (p, r) in enumerate(zip(first["paths"], first["records"], strict=True), 1)], "place long, path string, kind string, size long, matched long, returned long, refused boolean")


def tool_answers(s: SparkSession, d: str) -> DataFrame:
    reply = serve.Tools(asked(s, d), ["/parts/Brand-1", "/parts/Brand-11"]).handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "red", "limit": 9}}})
    found = reply["result"]["structuredContent"]
    return s.createDataFrame([(i, p, found["matched"], found["returned"]) for i, p in enumerate(found["paths"], 1)], "place long, path string, matched long, returned long")


SERVED = "row_number() over (order by score desc, mtime desc, path, native_id, source)"
LINE, TOOL = replace(parse("red brand-1"), limit=7, scope_roots=("/parts",), scope_case_sensitive=True), replace(parse("red"), limit=9, scope_roots=("/parts/Brand-1", "/parts/Brand-11"), scope_case_sensitive=True)
register("serve_lines", line_answers, f"select {SERVED} as place, path, lower(kind) as kind, size, matched, count(*) over () as returned, true as refused from ({search_sql(duck('files_part'), LINE)}) h")
register("serve_tools", tool_answers, f"select {SERVED} as place, path, matched, count(*) over () as returned from ({search_sql(duck('files_part'), TOOL)}) h")

# bounds of requests, roots and limits

LIMITS = [None, -5, 0, 1, 50, 999, 1000, 1001, 1 << 40]
register("serve_limits", lambda s, d: s.createDataFrame([(v, serve.clamped(v)) for v in LIMITS], "asked long, given long"), f"select asked, cast(greatest(1, least(1000, coalesce(asked, 50))) as bigint) as given from {values([(v,) for v in LIMITS], 'asked')} t")
REQUESTS = [(limit, terms, roots, root, size) for limit in (0, 1, 10_000, 10_001) for terms, size in ((0, 1), (32, 3), (33, 3), (2, 40_000)) for roots, root in ((0, "/"), (1, "/a"), (32, "C:/x"), (33, "/a"), (1, "rel"))]


def valid(limit: int, terms: int, roots: int, root: str, size: int) -> bool:
    try:
        validate(Query(terms=("x" * size,) * terms, limit=limit, scope_roots=(root,) * roots))
    except ValueError:
        return False
    return True


register("request_bounds", lambda s, d: s.createDataFrame([(*r, valid(*r)) for r in REQUESTS], "n long, terms long, roots long, root string, size long, ok boolean"),
         f"select *, n between 1 and {MAX_RESULTS} and terms <= {MAX_TERMS} and roots <= {MAX_ROOTS} and (roots = 0 or regexp_matches(root, '^(/|[A-Za-z]:/)')) and terms * size + roots * strlen(root) <= {MAX_TEXT_BYTES} as ok from {values(REQUESTS, 'n, terms, roots, root, size')} t")
SCAN_ROOTS = ["/mnt/a", "/mnt/a/", "/mnt", "/mnt/ab", "/mnt/../etc", "/mnt/./x", "rel", "/mntx", "/", "/mnt/a/b.c", "C:/mnt"]


def root_ok(root: str) -> bool:
    try:
        return mounts.validate_roots([root], ["/mnt"]) == [root]
    except ValueError:
        return False


register("scan_root_bounds", lambda s, d: s.createDataFrame([(r, root_ok(r)) for r in SCAN_ROOTS], "root string, ok boolean"),
         f"select root, starts_with(root, '/') and not regexp_matches(root, '(^|/)[.]{{1,2}}(/|$)') and (rtrim(root, '/') = '/mnt' or starts_with(root, '/mnt/')) as ok from {values([(r,) for r in SCAN_ROOTS], 'root')} t")
SETTINGS = ["/b/", "/a", "relative", "C:\\x\\", "/a/", "/", "\\\\srv\\share", "a/b", "/b"]
register("settings_roots", lambda s, d: s.createDataFrame([(r,) for r in view.settings_roots(SETTINGS)], "root string"),
         f"select distinct case when rtrim(replace(v, '\\', '/'), '/') = '' then '/' else rtrim(replace(v, '\\', '/'), '/') end as root from {values([(v,) for v in SETTINGS], 'v')} t where regexp_matches(v, '^(/|[A-Za-z]:[/\\\\]|\\\\\\\\)')")
DEVICE = ["//?/C:/Users/x/", "//./pipe/a", "//?/UNC/srv/share/f", r"\\?\D:\data\\y", "/a//b/", "C:/", "//srv//share/", "/", "c:\\"]
PLAIN_P = "case when starts_with(q, '//?/UNC/') then '//' || substr(q, 9) when starts_with(q, '//?/') or starts_with(q, '//./') then substr(q, 5) else q end"
register("fn_client_text", lambda s, d: s.createDataFrame([(v,) for v in DEVICE], "v string").unionByName(odd(s, d).select(F.col("path").alias("v"))).select("v", paths.client_text("v").alias("value")),
         f"select v, case when length(r) > 3 then regexp_replace(r, '/+$', '') else r end as value from (select v, case when starts_with(u, '//') then '/' else '' end || regexp_replace(u, '/+', '/', 'g') as r from (select v, {PLAIN_P} as u from (select v, replace(v, '\\', '/') as q from (select * from {values([(v,) for v in DEVICE], 'v')} a union all select path from ({ODD_ALL}) o) b) c) e) f")
register("mount_lookup", lambda s, d: mounts.looked_up(mounted(s), "/mnt/my disk//"), f"select * from {MOUNT_SQL} m where mountpoint = '/mnt/my disk'")

# scans from native bytes

MOVED = "select case id when 5 then {0} else id end as id, case parent when 5 then {0} else parent end as parent, parent_seq, sequence, name, is_dir, size from ({1}) t0"
ROW = "path, size, {mtime} as mtime, cast({mode} as bigint) as mode, case when is_dir then 'Dir' else 'File' end as kind, '{fs}' as fs, id as native_id, parent as native_parent, cast(0 as bigint) as source"


def moved(s: SparkSession, d: str, root: int) -> DataFrame:
    return tree(s, d).withColumn("parent", F.when(F.col("parent") == 5, F.lit(root).cast("long")).otherwise(F.col("parent")))


MODE = "case when is_dir then 16877 else 33188 end"
register("scan_btrfs", lambda s, d: native.scan("btrfs", {"items": native.sharded(tree_items(moved(s, d, 256), 256), 100_000_000, 1).drop("shard")}, "/vol"),
         f"select {ROW.format(mtime='id + 7', mode=MODE, fs='btrfs')} from (select id, parent, '/vol' || path as path, is_dir, size from ({walk_sql(MOVED.format(256, TREE), 256)}) w union all select 256, 0, '/vol', true, 0) x")


def ext_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    t = moved(s, d, 2)
    kinds = F.when(F.col("is_dir"), 0o040755).otherwise(0o100644).cast("long")
    inodes = t.select("id", kinds.alias("mode"), F.when(F.col("id") % 7 == 0, F.when(F.col("is_dir"), 2).otherwise(0)).otherwise(1).cast("long").alias("links"), (F.col("size") % (1 << 32)).alias("size_low"), (F.col("size") % 3).alias("size_high"), (F.col("id") + 1).alias("mtime"))
    entries = t.select("parent", "id", "name", F.col("id").alias("ord"))
    dots = t.filter("is_dir").select(F.col("id").alias("parent"), F.col("parent").alias("id"), F.lit("..").alias("name"), F.lit(0).cast("long").alias("ord"))
    own = t.filter("is_dir").select(F.col("id").alias("parent"), "id", F.explode(F.array(F.lit("."), F.lit(""))).alias("name"), F.lit(1).cast("long").alias("ord"))
    return {"inodes": inodes, "entries": entries.unionByName(dots).unionByName(own)}


register("scan_ext", lambda s, d: native.scan("ext4", ext_tables(s, d), "/disk"),
         f"select {ROW.format(mtime='id + 1', mode=MODE, fs='ext4')} from (select w.id, w.parent, '/disk' || w.path as path, w.is_dir, case when w.is_dir then w.size else w.size + (w.size % 3) * 4294967296 end as size from ({walk_sql(MOVED.format(2, TREE), 2)}) w where w.is_dir or w.id % 7 <> 0) x")
register("scan_ntfs", lambda s, d: native.scan("ntfs", {"records": table_records(tree(s, d))}, "D:\\"), f"select 'D:' || path as path, size, cast(1700000000 as bigint) as mtime, cast(0 as bigint) as mode, case when is_dir then 'Dir' else 'File' end as kind, 'ntfs' as fs, id as native_id, parent as native_parent, cast(0 as bigint) as source from ({walk_sql(TREE, 5, SEQUENCE)}) w")
register("scan_listed", lambda s, d: native.listed_files(load(s, d, "files_docs").filter("native_id % 3 <> 0").select("path"), load(s, d, "files_docs").filter("native_id % 2 = 0").select("path", "size", "mtime", "mode"), "apfs"),
         f"select path, size, mtime, mode, 'File' as kind, 'apfs' as fs, cast(0 as bigint) as native_id, cast(0 as bigint) as native_parent, cast(0 as bigint) as source from ({duck('files_docs')}) p where native_id % 6 in (2, 4)")

# events


register("event_buffers", lambda s, d: kernel.parse(event_buffers(events(s, d))).select("seq", F.array_join("mask", "|").alias("masks"), "role", "name", F.hex("handle").alias("handle")),
         f"select seq, case op when 'Remove' then 'DELETE' else 'CLOSE_WRITE|CREATE' end as masks, 'Current' as role, split_part(path, '/', -1) as name, '0800000000000000' || string_agg(lpad(upper(to_hex((seq >> (8 * i)) & 255)), 2, '0'), '' order by i) as handle from ({duck('changes_events')}) c, range(8) r(i) group by seq, op, path")


def followed(s: SparkSession, d: str) -> tuple[Store, list[dict]]:
    """Raw events in files, applied as a stream of two files a batch."""
    store = new_store(s)
    store.build(load(s, d, "files_part"))
    c = full_changes(s, d)
    raw = c.select("*", F.when(F.col("op") == "Remove", F.array(F.lit("DELETE"))).otherwise(F.array(F.lit("CLOSE_WRITE"), F.lit("CREATE"))).alias("mask"), F.lit("Current").alias("role"), F.lit(True).alias("named"), (F.col("op") == "Upsert").alias("present"))
    raw.drop("op", "batch_id").repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{store.root}-in")
    query = stream.follow_events(stream.read_events(s, f"{store.root}-in", 2), store, f"{store.root}-progress")
    query.awaitTermination()
    return store, stream.progress(query)


register("stream_follow_events", lambda s, d: followed(s, d)[0].files(), LIVE)
register("stream_progress", lambda s, d: s.createDataFrame([(sum(p["rows"] for p in followed(s, d)[1]),)], "events long"), f"select count(*) as events from ({duck('changes_events')}) c")
