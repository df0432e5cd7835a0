"""DuckDB texts of the queries that SQL can express."""

OP8 = r"""
with d as (select doc_id, row_number() over () as row_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, w[i:least(i + 9, len(w))] as win from b, unnest(generate_series(1, greatest(len(w) - 9, 1))) as g(i) where len(w) > 0),
lens as (select distinct len(win) as k from win),
places as (select row_id, i, k, w[i:i + k - 1] as win from d, lens, unnest(generate_series(1, len(w) - k + 1)) as g(i) where len(w) >= k),
hit as (select row_id, i, k, item_id from places join win using (win)),
covered as (select row_id, count(distinct p) as n_hit from hit, unnest(generate_series(i, i + k - 1)) as g(p) group by row_id),
named as (select row_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct row_id, cast(item_id as varchar) as id from hit) group by row_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (row_id) left join named using (row_id)
"""

_SHRUNK = """
{name}_seen as (select * from {units} where n > 0),
{name}_sums as (select count(*) as k, sum(n) as n, sum(n * n) as nn, sum(n * (bad / n - m) * (bad / n - m)) as ss, sum(m * (1 - m)) as v from {name}_seen),
{name}_excess as (select *, (ss - v * (k - 1) / k) / greatest(n - nn / n, 1.0) as e from {name}_sums),
{name}_s as (select case when k < 2 or e <= 0 then 1000.0 else least(greatest(v / k / e - 1.0, 2.0), 1000.0) end as s from {name}_excess),
{name}_ab as (select u.*, bad + s * m as a, n - bad + s * (1 - m) as b from {units} u, {name}_s),
{name} as (select *, a / (a + b) as rate, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low from {name}_ab)
"""


def shrunk(name: str, units: str) -> str:
    return _SHRUNK.format(name=name, units=units).strip()


OP9 = f"""
with p as (select page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
marks as (select doc_id as page_id, max(cast(quality = 0 or toxic = 1 as int)) as bad from labels where doc_id is not null group by 1),
counted as (select host, cast(count(bad) as double) as n, cast(coalesce(sum(bad), 0) as double) as bad from p left join marks using (page_id) group by 1),
parts as (select *, string_split(host, '.') as l from counted),
levels as (select host, n, bad, array_to_string(l[-(case when two then 2 else 1 end):], '.') as suffix, array_to_string(l[-(case when two then 3 else 2 end):], '.') as domain
  from (select *, len(l) >= 3 and length(l[-1]) = 2 and l[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') as two from parts)),
suffix_n as (select suffix, sum(n) as n, sum(bad) as bad from levels group by 1),
grand as (select (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) as m from suffix_n),
suffix_u as (select suffix_n.*, m from suffix_n, grand),
{shrunk('suffix_p', 'suffix_u')},
domain_u as (select d.*, s.rate as m from (select suffix, domain, sum(n) as n, sum(bad) as bad from levels group by 1, 2) d join suffix_p s using (suffix)),
{shrunk('domain_p', 'domain_u')},
host_u as (select l.host, l.n, l.bad, d.rate as m from levels l join domain_p d using (domain)),
{shrunk('host_p', 'host_u')},
ruled as (select *, case
  when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from p)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' when low > 0.5 then 'block' else 'allow' end as verdict
from ruled join host_p using (host)
"""

OP10 = f"""
with d as (select row_number() over () as row_id, doc_id, source as host, coalesce(text, '') as text from documents),
m as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
win as (select row_id, i, array_to_string(w[i:i + 4], chr(10)) as g from m, unnest(generate_series(1, len(w) - 4)) as t(i) where len(w) >= 5),
again as (select row_id, i from win qualify count(*) over (partition by row_id, g) >= 2),
rep as (select row_id, count(distinct p) as n from again, unnest(generate_series(i, i + 4)) as t(p) group by 1),
q as (select m.row_id, doc_id, host, cast(len(w) as bigint) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  coalesce(rep.n, 0) as n_repeat_words from m left join rep on rep.row_id = m.row_id),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from q),
hosts as (select host, cast(count(*) as double) as n, cast(sum(cast(base_failed as int)) as double) as bad from f group by 1),
grand as (select (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) as m from hosts),
host_u as (select hosts.*, m from hosts, grand),
{shrunk('host_p', 'host_u')}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (low > 0.5) as kept
from f join host_p on f.host is not distinct from host_p.host
"""

OP3 = r"""
with d as (select row_number() over () as row_id, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
  md5(concat_ws('|', 'mix', coalesce(cast(doc_id as varchar), ''))) as h from documents),
src as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
numbered as (select *, row_number() over (order by source nulls last) - 1 as s from src),
weighed as (select *, case s % 3 when 0 then 5 when 1 then 2 else 1 end as w, cast(2 * source_size as double) as cap from numbered),
ordered as (select *, 1.5 * sum(source_size) over () as total, row_number() over (order by cap / w, s) as o from weighed),
filled as (select *, cast(total as double) - coalesce(sum(cap) over (order by o rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(w) over (order by o desc) as ws from ordered),
free as (select o as first_free, rest / ws as level from filled where cap > w * (rest / ws) order by o limit 1),
aimed as (select source, source_size, case when first_free is null or o < first_free then cap else w * level end as target from filled left join free on true),
placed as (select d.*, source_size, target, cast(floor(target) as bigint) as quota,
  sum(size) over (partition by d.source order by h, doc_id, size, row_id rows unbounded preceding) as stop
  from d join aimed on d.source is not distinct from aimed.source)
select doc_id, size, source_size, target, cast(
  greatest(least(stop, quota) - (stop - size), 0) + greatest(least(stop + source_size, quota) - (stop + source_size - size), 0) as bigint) as taken from placed
"""

OP1 = r"""
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f as (select *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + length(role) + 32
  + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from f group by conv_id
"""

OP12 = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(u, v) as (
  select vec_id, vec_id from embeddings union select r.u, l.v from reach r join links l on r.v = l.u),
lowest as (select u, min(v) as m from reach group by u),
counts as (select u, count(distinct v) as n from links group by u)
select e.vec_id, coalesce(n, 0)::bigint as n_links, m as component_id, coalesce(e.vec_id = m, true) as kept
from embeddings e left join lowest l on e.vec_id = l.u left join counts c on e.vec_id = c.u
"""

OP13 = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
sizes as (select unnest(range(1, 6)) as size),
grams as (
  select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
  from words, sizes where len(w) >= size),
f as (select lang, size, phrase, count(*) as a from grams group by all having count(*) >= 100),
cand as (select *, string_split(phrase, ' ') as w from f where size > 1),
cuts as (
  select lang, phrase, a, size, w, unnest(range(1, size)) as k from cand),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.a as l, y.a as r, t.n, (1000::hugeint * c.a * t.n) // (x.a::hugeint * y.a) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ') join totals t on t.lang = c.lang),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select o.lang, array_to_string(o.w[s.i:s.i + s.m - 1], ' ') as phrase, max(o.a) as outer_a
  from cand o, (select i, m from range(1, 6) a(i), range(2, 6) b(m)) s where s.m < o.size and s.i + s.m - 1 <= o.size group by all),
kept as (
  select w.* from weakest w left join inside i on i.lang = w.lang and i.phrase = w.phrase where i.phrase is null or 100 * i.outer_a < 100 * w.a)
select lang, rank, phrase, a, l, r, n, score::bigint as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000
"""
