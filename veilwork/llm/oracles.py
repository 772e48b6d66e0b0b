"""DuckDB SQL for the operators that SQL can express."""

OP5 = """
with recursive d as (
  select row_number() over () as r, doc_id, source,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as o
  from documents),
names as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as no
  from d group by source),
-- sources reach their limit one round after the other; what is left is shared among the others
rounds(n, no, capped, part) as (
  select 0, no, false, 0.0::double from names
  union all
  select n + 1, no, capped or share > 3 * source_size, case when capped or share > 3 * source_size then 3.0 * source_size else share end
  from (
    select n, no, source_size, capped,
           (1 + no % 3) * (sum(source_size) over () - coalesce(sum(3.0 * source_size) filter (capped) over (), 0))
           / sum(1.0 + no % 3) filter (not capped) over () as share
    from rounds join names using (no))
  where n <= (select count(*) from names)),
s as (
  select source, no, source_size, part as target, cast(round(part) as bigint) as quota,
         sum(case when no % 3 = 0 then round(part) else 0 end) over () as rising,
         sum(case when no % 3 = 1 then round(part) else 0 end) over () as falling,
         sum(case when no % 3 = 2 then round(part) else 0 end) over () as level
  from names join (select * from rounds where n = (select max(n) from rounds)) using (no)),
p as (
  select d.r, d.doc_id, d.size, s.*,
         cast(coalesce(sum(d.size) over (partition by d.source order by d.o, d.doc_id nulls first, d.size
              rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from d join s on d.source is not distinct from s.source),
k as (select *, unnest([0, 1, 2, 3]) as k from p),
m as (
  select r, k, least(size, quota - k * source_size - start) as words, rising, falling, level,
         case no % 3 when 0 then (sqrt(1 + 8 * x) - 1) / 2 when 1 then (3 - sqrt(greatest(0, 9 - 8 * x))) / 2 else x end as t
  from (select *, least(1, (start + k * source_size) / quota) as x from k) z
  where size > 0 and start + k * source_size < quota),
w as (
  select r, sum(words) as taken, min(pos) as position, string_agg(cast(pos as varchar), ',' order by k) as positions
  from (
    select *, cast(floor(0.001 + rising * t * (1 + t) / 2 + falling * t * (3 - t) / 2 + level * t) as bigint) as pos from m)
  group by r)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken, position,
       coalesce(positions, '') as positions
from p left join w using (r)
"""

OP10 = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (
  select *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (
  select key, max(doc_id) as owner from k where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
j as (
  select k.*, coalesce(f.owner <> k.doc_id, false) as gone from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""

OP1 = """
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as p from d),
g as (
  select doc_id, p, array_to_string(list_slice(ws, p, p + 19), ' ') as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as p from d)),
r as (select doc_id, p, row_number() over (partition by g order by doc_id, p) as k from g),
c as (select distinct doc_id, unnest(range(p, p + 20)) as p from r where k > 1),
j as (select w.*, c.p is not null as gone from w left join c on w.doc_id = c.doc_id and w.p = c.p),
n as (
  select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed,
         string_agg(w, ' ' order by p) filter (not gone) as kept
  from j group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join n on d.doc_id = n.doc_id
"""

OP6 = """
with d as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (
  select r, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as w,
         generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) as p from d),
g as (
  select r, p, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as g
  from w window o as (partition by r order by p)),
t as (select r, p from (select *, count(*) over (partition by r, g) as n from g where g is not null) where n > 1),
c as (select r, count(distinct q) as n_repeat_words from (select r, unnest([p, p + 1, p + 2]) as q from t) group by r),
l as (select r, source, text, unnest(string_split(text, chr(10))) as line from d),
k as (
  select *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                                     '[\\x20\\x09-\\x0D]+', ' ', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
f as (select source, key from k group by source, key having count(distinct text) > 20),
x as (
  select k.r, count(*) - count(distinct line) as n_dup_lines,
         coalesce(sum(len(string_split(k.key, ' '))) filter (f.key is not null), 0) as gone
  from k left join f on k.key = f.key and k.source is not distinct from f.source group by k.r),
m as (
  select d.doc_id, cast(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
         cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         cast(coalesce(gone, 0) as bigint) as n_line_words_removed
  from d left join c on d.r = c.r left join x on d.r = x.r)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
       and n_words - n_line_words_removed >= 0.5 * n_words as kept
from m
"""

OP2 = """
with d as (select row_number() over () as r, doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) as text from documents),
cut as (
  select r, 0 as no, regexp_replace(text, '@ASSIGN@', chr(57344) || '\\0' || chr(57344), 'g') as t from d union all
  select r, 1, regexp_replace(text, 'AKIA[A-Z0-9]+', chr(57344) || '\\0' || chr(57344), 'g') from d union all
  select r, 2, regexp_replace(text, '[0-9a-f]+', chr(57344) || '\\0' || chr(57344), 'g') from d union all
  select r, 3, regexp_replace(text, '[A-Za-z0-9+/_=-]{20,}', chr(57344) || '\\0' || chr(57344), 'g') from d),
p as (select r, no, unnest(string_split(t, chr(57344))) as part, generate_subscripts(string_split(t, chr(57344)), 1) as pos from cut),
o as (
  select *, cast(coalesce(sum(length(part)) over (partition by r, no order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as s
  from p),
m as (select r, no, part, s, s + length(part) as e from o where pos % 2 = 0),
base as (
  select r, no, s, e from m
  where no = 0 and length(regexp_extract(part, '@ASSIGN@', 2)) >= 6 or no = 1 and length(part) >= 20 or no = 2 and length(part) >= 24),
-- ordinary names, written out
raws as (select unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')) as raw from d),
ws as (
  select regexp_replace(raw, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') as w, count(*) as n from raws where raw <> '' group by raw),
names as (
  select n, unnest([w, w || '_' || w, upper(w || '_' || w), lower(w) || upper(w[1]) || lower(w[2:]) || (n % 100), w || '/' || w || '-' || (n % 100)]) as token
  from ws where regexp_full_match(w, '[A-Za-z]{2,}')),
ordinary as (
  select token[i] as a, token[i + 1] as b, sum(n) as n
  from (select *, unnest(range(1, length(token))) as i from names) group by all),
-- random strings, by rule
hashed as (select id, sha256(cast(id as varchar)) as h, to_base64(unhex(sha256(cast(id as varchar)))) as b from range(20000) t(id)),
drawn as (
  select case id % 4 when 0 then h[1:40] when 1 then b when 2 then replace(translate(b, '+/', '-_'), '=', '')
         else upper(replace(replace(replace(b, '+', ''), '/', ''), '=', '')) end as token from hashed),
random as (
  select token[i] as a, token[i + 1] as b, count(*) as n
  from (select *, unnest(range(1, length(token))) as i from drawn) group by all),
chars as (select unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-', '')) as c),
cells as (
  select x.c as a, y.c as b, 1.0::double + coalesce(r.n, 0) as hi,
         1.0::double + coalesce(q.n, 0) * least(1.0::double, (select sum(n) from random) / greatest(1, (select sum(n) from ordinary))) as lo
  from chars x cross join chars y
  left join random r on r.a = x.c and r.b = y.c left join ordinary q on q.a = x.c and q.b = y.c),
ratio as (
  select a, b, round(ln(hi / sum(hi) over (partition by a)) - ln(lo / sum(lo) over (partition by a)), 6) as v from cells),
tokens as (
  select row_number() over () as k, m.* from m
  where no = 3 and len(list_distinct(string_split(part, ''))) >= 6
    and not exists (select 1 from base b where b.r = m.r and b.s < m.e and m.s < b.e)),
pieces as (
  select k, r, s, e, unnest(list_distinct(list_prepend(part, list_filter(string_split_regex(part, '[/_=-]+'), lambda x: length(x) >= 20)))) as piece from tokens),
scores as (
  select k, r, s, e, piece, sum(v) / (length(piece) - 1) as mean
  from (select *, unnest(range(1, length(piece))) as i from pieces) z join ratio on a = piece[i] and b = piece[i + 1]
  group by k, r, s, e, piece),
found as (select r, no, s, e from base union all select distinct r, 3, s, e from scores where mean > 0.5),
named as (select *, ['assign', 'access', 'hex', 'random'][no + 1] || ':' || s || ':' || e as span from found)
select doc_id, count(*) filter (no = 0) as n_assign, count(*) filter (no = 1) as n_access, count(*) filter (no = 2) as n_hex,
       sha256(coalesce(string_agg(span, ',' order by s, no, e) filter (no < 3), '')) as base_sha256,
       coalesce(string_agg(span, ',' order by s, no, e), '') as spans
from d left join named using (r) group by r, doc_id
""".replace("@ASSIGN@", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""".replace("\\\\", "\\"))

ORACLES = {
    "op1_substring_dedup": OP1,
    "op2_secrets": OP2,
    "op5_mixing": OP5,
    "op6_quality": OP6,
    "op10_line_dedup": OP10,
}
