"""DuckDB SQL for the queries that SQL can express, written from the
contracts, independent of the operators."""

from __future__ import annotations

#: CRC-32 of a text's bytes, bit by bit (reflected polynomial 0xEDB88320).
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint,
  list_transform(range(8 * octet_length(encode(text))),
                 lambda i: get_bit(encode(text)::bit, ((i // 8) * 8 + 7 - i % 8)::int)::bigint)),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""

OP2 = f"""
with sized as (
  select doc_id, coalesce(octet_length(encode(text)), 0) + 1 as size, {_CRC} as text_crc32 from documents),
placed as (
  select *, sum(size) over (order by doc_id, text_crc32 rows unbounded preceding) - size as b, sum(size) over () as total
  from sized),
cut as (select *, least(7, (2 * b + size) * 8 // (2 * total)) as s from placed)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, s::int as shard,
  (row_number() over (partition by s order by doc_id, text_crc32) - 1)::bigint as slot,
  null::int as grown_shard, b::bigint as "offset"
from cut"""

OP9 = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p
      from (select r, regexp_extract_all(t, '[^ \t-\r]+') as ws from d)),
wc as (select r, count(*) as n_words, sum(length(word)) as word_chars from w group by r),
tri as (select r, p, word as a, lead(word) over o as b, lead(word, 2) over o as c from w window o as (partition by r order by p)),
twice as (select r, a, b, c from tri where c is not null group by all having count(*) > 1),
inside as (select distinct r, p + k as p from tri semi join twice using (r, a, b, c), range(3) as s(k)),
rep as (select r, count(*) as n from inside group by r),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
dup as (select r, count(*) as n_lines, count(*) - count(distinct line) as n from l where regexp_matches(line, '[^ \t-\r]') group by r),
m as (
  select d.r, doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_lines, 0) as n_lines, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
  from d left join wc using (r) left join rep using (r) left join dup using (r)),
f as (
  select *,
    (case when n_words < 50 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > 3 * word_chars then 4 else 0 end)
    + (case when n_lines >= 4 and 10 * n_dup_lines > 7 * n_lines then 8 else 0 end)
    + (case when n_words >= 50 and word_chars > 40 * n_words then 16 else 0 end)
    + (case when n_words >= 50 and 2 * word_chars < 3 * n_words then 32 else 0 end) as failures
  from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  failures & 3 <> 0 as base_failed, failures = 0 as kept, failures::bigint as failures, 'web-1' as policy
from f"""

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
with d as (select row_number() over () as r, doc_id, {_TOKENS} as ws from documents),
i as (select item_id, ws, least(10, len(ws)) as k from (select item_id, {_TOKENS} as ws from benchmark) where len(ws) > 0),
win as (select distinct item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) as g from i),
pos as (select r, k, unnest(range(1, len(ws) - k + 2)) as p,
          unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) as g
        from d, (select distinct k from win)
        where len(ws) >= k),
hit as (select r, p, k, item_id from pos join win using (k, g)),
words as (select r, count(distinct q) as n from (select r, unnest(range(p, p + k)) as q from hit) group by r),
items as (select r, count(*) as n, string_agg(item, ',' order by item) as ids
          from (select distinct r, item_id::varchar as item from hit) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(words.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)"""

OP3 = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (select r, p, md5(substr(h, 2 * p + 1, 400)) as g from (select r, h, unnest(range(length(h) // 2 - 199)) as p from d where length(h) >= 400)),
twice as (select g from win group by g having count(*) > 1),
hit as (select r, p from win semi join twice using (g)),
edge as (select r, p, sum(x) as x from (select r, p, 1 as x from hit union all select r, p + 200, -1 from hit) group by r, p),
depth as (select r, p, sum(x) over (partition by r order by p) as n, x from edge),
cut as (select r, p as a, lead(p) over (partition by r order by p) as b, n from depth),
runs as (select r, a, b, case when lag(b) over (partition by r order by a) = a then 0 else 1 end as new from cut where n > 0),
span as (select r, min(a) as a, max(b) as b
         from (select *, sum(new) over (partition by r order by a) as k from runs) group by r, k),
gap as (select r, b as a, lead(a, 1, 1000000000) over (partition by r order by a) as b from span
        union all select r, 0, min(a) from span group by r),
kept as (select r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as h from gap join d using (r) group by r),
lost as (select r, sum(b - a) as n, count(*) as spans from span group by r)
select doc_id, (length(d.h) // 2)::bigint as n_bytes, coalesce(lost.n, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join lost using (r) left join kept using (r)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^ \t-\r]+') as ws from documents),
sh as (select distinct doc_id, md5(array_to_string(ws[p:p + 3], ' ')) as g
       from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as p from d where len(ws) > 0)),
size as (select doc_id, count(*) as n from sh group by doc_id),
pair as (select a.doc_id as u, b.doc_id as v, count(*) as shared from sh a join sh b using (g) where a.doc_id < b.doc_id group by all),
link as (select u, v from pair join size x on u = x.doc_id join size y on v = y.doc_id where 100 * shared >= 80 * (x.n + y.n - shared)),
edge as (select u, v from link union all select v, u from link),
reach as (select u, v from edge union select reach.u, edge.v from reach join edge on reach.v = edge.u),
low as (select u, min(v) as m from reach group by u)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(m, doc_id) as component_id, coalesce(m, doc_id) = doc_id as kept
from d left join size using (doc_id) left join low on u = doc_id"""

OP8 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as ws from documents),
win as (select doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) as g from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as p from d where len(ws) >= 20)),
later as (select doc_id, p from (select doc_id, p, row_number() over (partition by g order by doc_id, p) as k from win) where k > 1),
cut as (select distinct doc_id, p + i as p from later, range(20) as s(i)),
w as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from w anti join cut using (doc_id, p) group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)"""

OP12 = rf"""
with piece as (select row_number() over () as r, coalesce(lang, 'und') as lang,
    unnest(string_split_regex({_LOWER}, '[.,;:!?\n\x0b\x0c\r]')) as t from documents),
w as (select lang, ws from (select lang, regexp_extract_all(t, '[^ \t]+') as ws from piece) where len(ws) > 0),
total as (select lang, sum(len(ws))::hugeint as n from w group by lang),
gram as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
         from w, range(1, 6) as s(k) where len(ws) >= k),
f as (select lang, k, phrase, string_split(phrase, ' ') as ws, count(*)::hugeint as a from gram group by all having count(*) >= 100),
cut as (
  select c.lang, c.phrase, c.a, x.a as l, y.a as r, total.n, x.k as first, (1000 * c.a * total.n) // (x.a * y.a) as score
  from f c join f x on x.lang = c.lang and x.k < c.k and x.phrase = array_to_string(c.ws[1:x.k], ' ')
    join f y on y.lang = c.lang and y.k = c.k - x.k and y.phrase = array_to_string(c.ws[x.k + 1:], ' ')
    join total on total.lang = c.lang),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, first) = 1),
part as (select distinct lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, a
         from f, range(2, 5) as s(m), range(1, 5) as t(i) where m < k and i + m - 1 <= k),
held as (select distinct best.lang, best.phrase from best join part on part.lang = best.lang and part.phrase = best.phrase and 100 * part.a >= 100 * best.a)
select lang, row_number() over o as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from best anti join held using (lang, phrase)
window o as (partition by lang order by score desc, a desc, phrase)
qualify row_number() over o <= 2000"""

OP13 = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, (row_number() over o)::int as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window o as (partition by anchor_id, positive_id order by score desc, id)
qualify row_number() over o <= 10"""

ORACLE: dict[str, str] = {
    "op2_sharding": OP2, "op3_suffix_dedup": OP3, "op6_minhash": OP6, "op8_phrase_automata": OP8,
    "op9_quality_rules": OP9, "op10_decontamination": OP10, "op12_collocations": OP12, "op13_hard_negatives": OP13,
}
