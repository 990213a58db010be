"""The same results in SQL for DuckDB, where SQL can express an operator over whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

#: crc32 byte by byte, with the table of 256 remainders built from its polynomial
SHARDING = r"""
with recursive step(b, k, v) as (
    select cast(range as bigint), 0, cast(range as bigint) from range(256)
    union all
    select b, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from step where k < 8),
crc as (select list(v order by b) as t from step where k = 8),
d as (select doc_id, coalesce(source, '') as source, source is null as none, coalesce(text, '') as text, md5('17:' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
bytes as (select doc_id, h, source, none, strlen(text) as size, hex(encode(text)) as x from d),
sums as (
    select doc_id, h, source, none, size,
           xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(cast(size as bigint)), lambda i: cast(('0x' || substr(x, 2 * i + 1, 2)) as bigint))),
                           lambda c, y: xor(c >> 8, crc.t[(xor(c, y) & 255) + 1])), 4294967295) as crc
    from bytes, crc),
placed as (
    select *, (row_number() over (partition by none, source order by h, doc_id, size, crc) - 0.5) / cast(count(*) over (partition by none, source) as double) as part,
           count(*) over () as total
    from sums),
ordered as (select *, row_number() over (order by part, none, source, h, doc_id, size, crc) - 1 as place from placed)
select doc_id, cast(size + 16 as bigint) as size, cast(crc as bigint) as text_crc32, 'rows' as law, cast(place * 40 // total as int) as shard,
       cast(place - ((place * 40 // total) * total + 39) // 40 as bigint) as slot, cast(null as int) as grown_shard
from ordered"""

#: words of a line between blanks and the like, as in the operator; rarity by the number of sets that hold a word
LINE_DEDUP = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as x from documents),
l as (select doc_id, unnest(range(len(x))) as line, unnest(x) as s from d where text is not null),
w as (select doc_id, line, s, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(s), '[\t\x0B\f\r]', ' ', 'g'), ' '), lambda v: v <> ''))) as ws from l),
c as (select *, row_number() over () as cls from (select ws, len(ws) as n, min((doc_id, line)) as first from w where len(ws) > 0 group by ws) q),
t as (select cls, n, unnest(ws) as word from c),
f as (select word, count(*) as df from t group by word),
p as (select cls, n, word from (select cls, n, word, row_number() over (partition by cls order by df, word) as k from t join f using (word)) q where k <= n - ceil(0.75 * n) + 1),
pairs as (select distinct a.cls as a, b.cls as b from p a join p b on a.word = b.word and a.cls <> b.cls and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
m as (select distinct b from pairs join c x on x.cls = a join c y on y.cls = b
      where x.first < y.first and 100 * len(list_intersect(x.ws, y.ws)) >= 75 * (x.n + y.n - len(list_intersect(x.ws, y.ws)))),
v as (select w.doc_id, w.line, w.s, coalesce((w.doc_id, w.line) <> c.first or m.b is not null, false) as gone from w left join c on w.ws = c.ws left join m on m.b = c.cls),
k as (select doc_id, cast(count(*) as int) as n_lines, cast(count(*) filter (gone) as int) as n_removed, coalesce(string_agg(s, chr(10) order by line) filter (not gone), '') as text from v group by doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed, k.text from d left join k using (doc_id)"""

DECONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
windows as (select distinct item, least(len(ws), 10) as size, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') as s
            from (select item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) as k from i where len(ws) > 0) q),
sizes as (select distinct size from windows),
spans as (select doc_id, k, size, array_to_string(ws[k : k + size - 1], ' ') as s
          from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as k from d, sizes where len(ws) >= size) q),
found as (select p.doc_id, p.k, p.size, w.item from spans p join windows w on w.size = p.size and w.s = p.s),
hits as (select doc_id, count(distinct at_word) as n_hit from (select doc_id, unnest(range(k, k + size)) as at_word from found) q group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from found) q group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)"""

QUALITY_RULES = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_SPACED}) as ws from documents),
grams as (select doc_id, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as k from d where len(ws) >= 3) q),
twice as (select doc_id, k from (select doc_id, k, count(*) over (partition by doc_id, g) as n from grams) q where n > 1),
again as (select doc_id, count(distinct w) as n from (select doc_id, unnest([k, k + 1, k + 2]) as w from twice) q group by doc_id),
lines as (select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from d) q where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id, line),
dups as (select doc_id, sum(n) as n_lines, sum(n - 1) as n_dup from lines group by doc_id),
f as (select d.doc_id, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
             coalesce(n_dup, 0) as n_dup, coalesce(n_lines, 0) as n_lines, coalesce(again.n, 0) as n_again,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper, length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) as letters
      from d left join dups using (doc_id) left join again using (doc_id)),
v as (select *, n_words < 50 or 100 * n_again > 50 * n_words as failed,
             10 * n_symbols > 3 * n_words or 2 * upper > letters or 2 * n_dup > n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words or 2 * letters < word_chars as bad from f)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup as bigint) as n_dup_lines, cast(n_again as bigint) as n_repeat_words,
       failed as base_failed, not failed and not bad as kept
from v"""

NGRAM_JOIN = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) as ws from documents),
s as (select distinct doc_id, array_to_string(ws[k : k + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as k from d where len(ws) > 0) q),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
    select doc_id, doc_id from documents
    union
    select r.doc_id, w.b from reach r join ways w on w.a = r.other)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, min(r.other) as component_id
from documents d left join n using (doc_id) join reach r using (doc_id) group by d.doc_id, n.n"""
