"""SQL (DuckDB) for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from metasearch.llm.sharding import CHUNKS, MULTIPLIER

WORDS = r"'[^\x20\x09-\x0D]+'"
FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def jaccard_components(n: int, num: int, den: int) -> str:
    return rf"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {FOLD}), {WORDS}) as w from documents),
s as (
  select distinct r, k from (
    select r, array_to_string(w[i : i + {n - 1}], ' ') as k from (select r, w, unnest(range(1, len(w) - {n - 2})) as i from d where len(w) >= {n})
    union all select r, array_to_string(w, ' ') from d where len(w) between 1 and {n - 1})),
n as (select r, count(*) as n from s group by r),
p as (select a.r as x, b.r as y, count(*) as c from s a join s b on a.k = b.k and a.r < b.r group by a.r, b.r),
e as (select x, y from p join n a on a.r = x join n b on b.r = y where {den} * c >= {num} * (a.n + b.n - c)),
both_ways as (select x, y from e union all select y, x from e),
reach as (select r, r as o from d union select reach.r, y from reach join both_ways on reach.o = x)
select any_value(d.doc_id) as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(t.doc_id) as component_id
from reach join d on d.r = reach.r join d t on t.r = reach.o left join n on n.r = reach.r group by reach.r"""


def suffix_dedup(length: int) -> str:
    return f"""
with d as (select row_number() over (order by doc_id) as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
g as (select r, i, md5(substr(h, 2 * i + 1, {2 * length})) as k from (select r, h, unnest(range(0, length(h) // 2 - {length - 1})) as i from d where length(h) >= {2 * length})),
f as (select k, min(r * 4294967296 + i) as m from g group by k having count(*) > 1),
late as (select r, i, i > lag(i) over (partition by r order by i) + {length} as gap from g join f using (k) where r * 4294967296 + i > m),
runs as (select r, min(i) as a, max(i) + {length} as b from (select r, i, count(*) filter (gap) over (partition by r order by i) as run from late) x group by r, run),
pieces as (select r, a, lag(b, 1, 0) over (partition by r order by a) as until_, b, lead(a) over (partition by r order by a) is null as last from runs),
cut as (
  select p.r, count(*) as spans, sum(b - a) as gone, string_agg(substr(h, 2 * until_ + 1, 2 * (a - until_)) || case when last then substr(h, 2 * b + 1) else '' end, '' order by a) as kept
  from pieces p join d on d.r = p.r group by p.r)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join cut on cut.r = d.r"""


def sharding(shards: int) -> str:
    step = f"(key * {MULTIPLIER}::uhugeint + 1) % 18446744073709551616::uhugeint"
    return f"""
with recursive bits(v, n, k) as (
  select range, range, 0 from range(256) union all select v, case when n & 1 = 1 then xor(n >> 1, 3988292384) else n >> 1 end, k + 1 from bits where k < 8),
crc_table as (select list(n order by v) as t from bits where k = 8),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, case when coalesce(doc_id, 0) < 0 then coalesce(doc_id, 0)::hugeint + 18446744073709551616 else coalesce(doc_id, 0)::hugeint end::uhugeint as key from documents),
bytes as (select r, i, ('0x' || substr(h, 2 * i + 1, 2))::bigint as b from (select r, h, unnest(range(0, length(h) // 2)) as i from (select r, hex(encode(text)) as h from d))),
crc as (select r, list_reduce(list(b order by i), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::bigint) as c from bytes, crc_table group by r, t),
walk(r, key, b, j, i) as (
  select r, key, -1, 0::bigint, 0 from d
  union all
  select r, key, b, floor((b + 1) * (2147483648.0::double / ((key >> 33)::double + 1)))::bigint, i from (select r, {step} as key, j as b, i + 1 as i from walk where j <= {shards})),
jumps as (select r, max(b) filter (b < {shards}) as shard, max(b) as grown from walk group by r),
rows as (
  select d.doc_id, strlen(text) + 16 as size, coalesce(xor(c, 4294967295), 0) as text_crc32, shard, grown, ((({step}) >> 22) & {CHUNKS - 1})::int as chunk
  from d join jumps using (r) left join crc using (r))
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by chunk, doc_id nulls first, size, text_crc32) - 1 as slot, grown::int as grown_shard from rows"""


def substring_dedup(window: int) -> str:
    return f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as w from documents),
g as (select r, doc_id, i, array_to_string(w[i : i + {window - 1}], ' ') as k from (select r, doc_id, w, unnest(range(1, len(w) - {window - 2})) as i from d where len(w) >= {window})),
f as (select k, min(doc_id) as m from g group by k),
gone as (select distinct r, unnest(range(i, i + {window})) as i from g join f using (k) where m < doc_id),
kept as (
  select x.r, count(*) filter (gone.i is not null) as n, string_agg(word, ' ' order by x.i) filter (gone.i is null) as t
  from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d) x left join gone on gone.r = x.r and gone.i = x.i group by x.r)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (r)"""
