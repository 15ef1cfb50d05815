"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_DECONTAMINATE = f"""
with docs as (select doc_id, {_WORDS} as ws from documents),
items as (select cast(item_id as varchar) as item, {_WORDS} as ws from benchmark),
sized as (select item, ws, least(10, len(ws)) as n from items where len(ws) > 0),
windows as (select distinct item, n, array_to_string(ws[p : p + n - 1], ' ') as win from (select item, ws, n, unnest(range(1, len(ws) - n + 2)) as p from sized)),
places as (select doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') as win from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from docs, (select distinct n from sized) where len(ws) >= n)),
met as (select doc_id, places.n, p, item from places join windows using (n, win)),
hit as (select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(p, p + n)) as w from met) group by doc_id),
own as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from met) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join own using (doc_id)"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_NEARDUP = rf"""
with recursive docs as (select doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (select distinct doc_id, hash(array_to_string(ws[p : p + least(5, len(ws)) - 1], ' ')) as s from (select doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) as p from docs where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select u, v from pairs join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * shared >= 85 * (x.n + y.n - shared)),
edges as (select u, v from links union all select v, u from links),
reach as (select doc_id as node, doc_id as seen from docs union select node, v from reach join edges on seen = u)
select docs.doc_id, coalesce(n, 0) as n_shingles, c as component_id, docs.doc_id = c as kept
from docs left join sizes using (doc_id) join (select node, min(seen) as c from reach group by node) on node = docs.doc_id"""

#: What each low byte does to a crc32, and the crc32 of a string by it: a scalar over ``steps``.
_STEPS = "crc_steps as (select list(c order by i) as steps from (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) as c from range(256) r(i)))"


def _crc(text: str) -> str:
    nibble = lambda k: f"(instr('0123456789ABCDEF', substr(hex({text}), 2 * i + {k}, 1)) - 1)"
    octets = f"list_transform(range(strlen({text})), lambda i: ({nibble(1)} * 16 + {nibble(2)})::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_RESAMPLING = f"""
with {_STEPS},
docs as (select doc_id, {_WORDS} as ws from documents),
features as (select doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as g from docs),
wanted as (select unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as g from (select {_WORDS} as ws from benchmark)),
own as (select doc_id, g, count(*) as k from features group by all),
target as (select g, count(*) as k from wanted group by all),
places as (select g, {_crc("g")} % 10000 as bucket from (select g from own union select g from target), crc_steps),
s as (select bucket, sum(k) as n from own join places using (g) group by bucket),
t as (select bucket, sum(k) as n from target join places using (g) group by bucket),
gains as (select bucket, floor(1000 * ln(cast(coalesce(t.n, 0) + 1 as double) * ((select coalesce(sum(n), 0) from s) + 10000) / (cast(coalesce(s.n, 0) + 1 as double) * ((select coalesce(sum(n), 0) from t) + 10000)))) as gain
from (select distinct bucket from places) left join s using (bucket) left join t using (bucket)),
sums as (select doc_id, sum(k) as n, sum(k * gain) as total from own join places using (g) join gains using (bucket) group by doc_id),
drawn as (select doc_id, (cast('0x' || substr(sha256('7:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double as u from docs),
scored as (select doc_id, len(ws) >= 20 as fit, cast(coalesce(n, 0) as bigint) as n_features, cast(coalesce(floor(total / n), 0) as bigint) as weight, cast(coalesce(floor(total / n), 0) + floor(-1000 * ln(-ln(u))) as bigint) as score
from docs left join sums using (doc_id) join drawn using (doc_id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as place from scored where fit)
select doc_id, n_features, weight, score, case when place <= (select count(*) from ranked) * 25 // 100 then place end as rank from scored left join ranked using (doc_id)"""

OP12_VARIANTS = rf"""
with recursive {_STEPS},
runs as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as r from documents)),
counted as (select doc_id, run, doc_id || ':' || run as k, count(*) as n from runs where length(run) >= 7 group by all),
hashed as (select run, n, {_crc("k")} as h from counted, crc_steps),
kept as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from kept where length(word) >= 7 group by word having sum(n) >= 2),
less as (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from words)),
pairs as (select a.word, b.word as near from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
union select less.word, words.word from less join words on rest = words.word union select words.word, less.word from less join words on rest = words.word),
best as (select pairs.word, count(*) as n_near, arg_min(near, (-o.n, near)) as near, max(o.n) as near_n from pairs join words o on o.word = near group by pairs.word),
formed as (select words.word, n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n from words left join best using (word)),
led as (select word, word as root, form as further from formed union all select led.word, led.further, formed.form from led join formed on formed.word = led.further)
select word, form, root, n, n_near, form_n from formed join (select word, root from led where further is null) using (word)"""
