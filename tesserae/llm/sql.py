"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tesserae.llm.op1_licences import TEMPLATES, THRESHOLD
from tesserae.llm.queries import ENTRIES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = r"[^\x20\x09-\x0D]+"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _words(column: str, pattern: str, lower: bool) -> str:
    text = f"translate({column}, '{_UP}', '{_LOW}')" if lower else column
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


def _grams(w: str, k: int) -> str:
    return f"list_distinct([array_to_string({w}[i:i+{k - 1}], ' ') for i in range(1, len({w}) - {k - 2})])"


OP1 = f"""
with templates as (select name, {_grams("w", 2)} g from (select name, {_words("text", _ITEM_WORDS, True)} w from (values {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in TEMPLATES)}) v(name, text))),
units as (
  select doc_id, unnest(string_split(text, chr(10))) u from documents
  union select doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) from documents
  union select doc_id, text from documents),
sized as (select doc_id, {_grams("w", 2)} g from (select doc_id, {_words("u", _ITEM_WORDS, True)} w from units where u is not null)),
found as (
  select doc_id, name, max(2.0::double * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g))) dice
  from sized s join templates t on len(s.g) >= len(t.g) * {THRESHOLD / (200 - THRESHOLD)} - 0.001 and len(s.g) <= len(t.g) * {(200 - THRESHOLD) / THRESHOLD} + 0.001
  where 200 * len(list_intersect(s.g, t.g)) >= {THRESHOLD} * (len(s.g) + len(t.g)) group by all)
select d.doc_id, (select name from found f where f.doc_id = d.doc_id order by dice desc, name limit 1) licence,
  coalesce(round((select max(dice) from found f where f.doc_id = d.doc_id), 6), 0.0::double) dice,
  coalesce((select string_agg(name, ',' order by name) from found f where f.doc_id = d.doc_id), '') licences
from documents d"""

OP2 = f"""
with b as (select cast(item_id as varchar) item, w, least(10, len(w)) m from (select item_id, {_words("text", _ITEM_WORDS, True)} w from benchmark) where len(w) > 0),
bw as (select distinct item, m, array_to_string(w[i:i+m-1], ' ') g from (select *, unnest(range(1, len(w) - m + 2)) i from b)),
d as (select doc_id, {_words("text", _ITEM_WORDS, True)} w from documents),
dw as (select doc_id, m, i, array_to_string(w[i:i+m-1], ' ') g from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from d, (select distinct m from bw))),
hits as (select dw.doc_id, dw.i, dw.m, bw.item from dw join bw on dw.m = bw.m and dw.g = bw.g),
n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + m)) p from hits) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (doc_id) left join it using (doc_id)"""

OP4 = f"""
with recursive d as (select doc_id, {_words("text", _WORDS, True)} w from documents),
s as (select doc_id, case when len(w) >= 3 then {_grams("w", 3)} when len(w) > 0 then [array_to_string(w, ' ')] else [] end g from d),
e as (select doc_id, len(g) n, unnest(g) x from s),
rare as (select x from e group by x having count(*) > 1),
p as (select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) c from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  where a.x in (select x from rare) group by all),
l as (select a, b from p where 100 * c >= 85 * (na + nb - c)),
both_ways as (select a, b from l union select b, a from l),
r(node, reach) as (select a, b from both_ways union select r.node, t.b from r join both_ways t on r.reach = t.a),
m as (select node, min(reach) reach from r group by node)
select doc_id, cast(len(g) as bigint) n_shingles, least(doc_id, coalesce(reach, doc_id)) component_id, least(doc_id, coalesce(reach, doc_id)) = doc_id kept
from s left join m on m.node = s.doc_id"""

OP6 = """
with v as (select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, case when len(q.e) = 0 then 0 else cast(list_inner_product([cast(x as double) for x in q.e], [cast(x as double) for x in c.e]) as bigint) end score
  from (select distinct * from v where vec_id % 20 = 0) q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, cast(row_number() over w as integer) "rank", vec_id, score from s
window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 20"""

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"

OP7 = f"""
with caps as (select page_id, url, date '2024-01-01' + cast(((page_id % 366) + 366) % 366 as integer) fetched_at, coalesce({_HOST}, '') host from pages),
drawn as (select host, h, date '2024-01-01' + h % 300 d from (select distinct host, ('0x' || substr(md5(host), 1, 4))::integer h from caps where host <> '') where h % 5 = 0),
entries as (
  select * from (values {", ".join(f"({_quoted(a)}, {_quoted(b)}, {_quoted(c)}, {_quoted(d)}, date {_quoted(e)})" for a, b, c, d, e in ENTRIES)}) v(list, kind, entry, action, since)
  union all select 'hosts', 'domain', host, 'add', d from drawn union all select 'hosts', 'domain', host, 'remove', d + 30 from drawn where h % 2 = 0),
changes as (select list, kind, entry, since, max(action) action from entries group by all),
iv as (select * from (select *, lead(since) over (partition by list, kind, entry order by since) until from changes) where action = 'add'),
parts as (select *, string_split(host, '.') l, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') p from caps),
keys as (
  select page_id, url, fetched_at, 'domain' kind, array_to_string(l[i:], '.') entry from (select *, unnest(range(1, len(l) + 1)) i from parts where host <> '')
  union select page_id, url, fetched_at, 'prefix', host || '/' || array_to_string(p[1:i], '/') from (select *, unnest(range(1, len(p) + 1)) i from parts where host <> '')
  union select page_id, url, fetched_at, 'url', url from parts where url is not null),
hit as (select distinct page_id, url, list || ':' || k.kind || ':' || k.entry m from keys k join iv on k.kind = iv.kind and k.entry = iv.entry and iv.since <= fetched_at and (until is null or fetched_at < until)),
agg as (select page_id, url, count(*) n, string_agg(m, ',' order by m) m from hit group by all)
select c.page_id, c.url, c.fetched_at, c.host, cast(coalesce(n, 0) as bigint) n_matches, coalesce(m, '') matches, m is not null blocked
from caps c left join agg a on a.page_id = c.page_id and a.url = c.url"""

OP9 = f"""
with d as (select doc_id, {_words("text", _WORDS, False)} w from documents),
win as (select doc_id, i, array_to_string(w[i:i+12], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d)),
f as (select g, min(doc_id) least_doc from win group by g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) p from win join f using (g) where least_doc < doc_id),
pos as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x from d),
kept as (select pos.doc_id, string_agg(x, ' ' order by pos.p) t, count(*) n from pos left join gone on gone.doc_id = pos.doc_id and gone.p = pos.p where gone.p is null group by pos.doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)"""

_ESC = r"""regexp_replace(replace({x}, '\', '\\'), '([<\[])(/?s>|/?ROLE\]|/?INST\])', '\1\\\2', 'g')"""

OP10 = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(length('<s>[ROLE]  [/ROLE] </s>') + length({_ESC.format(x="role")}) + length({_ESC.format(x="text")})) as bigint) formatted_chars
from t group by conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_licences": OP1, "op2_decontaminate": OP2, "op4_near_dedup": OP4, "op6_nearest": OP6, "op7_url_filter": OP7, "op9_substrings": OP9, "op10_chat": OP10}
