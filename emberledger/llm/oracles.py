"""DuckDB SQL for the rows of the registered queries, where SQL can express them."""

_BLANK = r"[\x20\x09-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_line_dedup": rf"""
with lines as (
  select doc_id, pos, list_extract(all_lines, pos) as line from (
    select doc_id, all_lines, unnest(range(1, len(all_lines) + 1)) as pos from (
      select doc_id, string_split(coalesce(text, ''), chr(10)) as all_lines from documents))),
keyed as (
  select *, translate(regexp_replace(regexp_replace(line, '^{_BLANK}+', ''), '{_BLANK}+$', ''),
                      '{_UPPER}', '{_LOWER}') as k from lines),
frequent as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20
  group by k having count(distinct doc_id) >= 3),
judged as (
  select d.*, f.k is not null and d.doc_id <> f.keeper as gone
  from keyed d left join frequent f using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id""",
    "op5_substring_dedup": rf"""
with split as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}+'),
    lambda x: x <> '') as w from documents),
windows as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') as k from (
    select doc_id, w, unnest(range(1, len(w) - 18)) as i from split where len(w) >= 20)),
later as (
  select doc_id, i from windows
  qualify row_number() over (partition by k order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as place from later),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from split),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by place) as t
  from words anti join gone using (doc_id, place) group by doc_id)
select s.doc_id, len(s.w) as n_words, len(s.w) - coalesce(k.n, 0) as n_removed,
  sha256(coalesce(k.t, '')) as kept_sha256
from split s left join kept k using (doc_id)""",
    "op9_ngram_jaccard_join": rf"""
with recursive split as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANK}+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 3), ' ') as k from (
    select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from split
    where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
both_of as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from shingles a join shingles b on a.k = b.k and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from both_of p join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * p.n >= 85 * (x.n + y.n - p.n)),
reached as (
  select doc_id as a, doc_id as b from split
  union select r.a, l.b from reached r join links l on r.b = l.a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, min(r.b) as component_id
from split d join reached r on r.a = d.doc_id left join sizes s on s.doc_id = d.doc_id
group by d.doc_id, s.n""",
    "op10_decontamination": r"""
with source as (
  select 'd' as kind, cast(doc_id as varchar) as id, text from documents
  union all select 'b', cast(item_id as varchar), text from benchmark),
split as (
  select kind, id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from source),
spans as (
  select id, unnest([array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ')
    for i in range(1, greatest(0, len(w) - 9) + 1 + cast(len(w) between 1 and 9 as int))]) as win,
    least(10, len(w)) as n from split where kind = 'b'),
sizes as (select distinct n from spans),
places as (
  select id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as win from (
    select id, w, n, unnest(range(1, len(w) - n + 2)) as i from split, sizes
    where kind = 'd' and len(w) >= n)),
found as (
  select p.id, p.i, p.n, s.id as item from places p join spans s on p.win = s.win and p.n = s.n),
hits as (
  select id, count(*) as n_hit from (
    select distinct id, unnest(range(i, i + n)) as place from (select distinct id, i, n from found))
  group by id),
items as (
  select id, count(distinct item) as n_items,
    string_agg(distinct item, ',' order by item) as names from found group by id)
select cast(d.id as bigint) as doc_id, len(d.w) as n_words, coalesce(h.n_hit, 0) as n_hit,
  coalesce(m.n_items, 0) as n_items, sha256(coalesce(m.names, '')) as items_sha256,
  coalesce(h.n_hit, 0) > 0 as contaminated
from split d left join hits h using (id) left join items m using (id) where d.kind = 'd'""",
    "op11_fill_in_middle": rf"""
with base as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || doc_id) as h,
    regexp_extract_all(coalesce(text, ''),
      '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
drawn as (
  select *, len(u) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1,
    cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 17, 8) as bigint) as h3,
    cast('0x' || substr(h, 25, 8) as bigint) as h4 from base),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
        or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select *, array_to_string(list_slice(u, 1, a), '') as p,
    array_to_string(list_slice(u, a + 1, b), '') as m,
    array_to_string(list_slice(u, b + 1, n), '') as s from cut),
made as (
  select *, case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end as o from parts),
found as (
  select *, strpos(o, '<P>') as at_p, strpos(o, '<S>') as at_s, strpos(o, '<M>') as at_m from made)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
  case when form <> 'plain' then length(m) end as middle_chars, sha256(o) as output_sha256,
  sha256(case form when 'plain' then o
    when 'psm' then substr(o, at_p + 3, at_s - at_p - 3) || substr(o, at_m + 3)
      || substr(o, at_s + 3, at_m - at_s - 3)
    else substr(o, at_p + 3, at_m - at_p - 3) || substr(o, at_m + 3)
      || substr(o, at_s + 3, at_p - at_s - 3) end) as restored_sha256
from found""",
}
