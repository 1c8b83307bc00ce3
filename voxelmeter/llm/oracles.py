"""DuckDB SQL for the results of the operators that SQL can express, over whole tables."""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORD_WINDOWS = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)),
late as (select doc_id, i from windows qualify row_number() over (partition by g order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from late),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w)
select w.doc_id, any_value(len(ws))::bigint as n_words, count(gone.i) as n_removed,
 sha256(coalesce(string_agg(word, ' ' order by words.i) filter (gone.i is null), '')) as kept_sha256
from w left join words on words.doc_id = w.doc_id left join gone on gone.doc_id = words.doc_id and gone.i = words.i group by w.doc_id"""

CONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id::varchar as item, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
wanted as (select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') as g from (select item, ws, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i
 from b where len(ws) > 0)),
hits as (select distinct doc_id, i, n, item from (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as g from
 (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from wanted) where len(ws) >= n)) join wanted using (g, n)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 as contaminated from d left join covered using (doc_id) left join found using (doc_id)"""

NEAR_GROUPS = rf"""
with recursive w as (select doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 1 then ws else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all)
 join n p on p.doc_id = a join n q on q.doc_id = b where 100 * shared >= 80 * (p.n + q.n - shared)),
reach(a, b) as (select doc_id, doc_id from documents union select reach.a, links.b from reach join links on reach.b = links.a)
select doc_id, coalesce(n, 0) as n_shingles, c as component_id, doc_id = c as kept from (select a as doc_id, min(b) as c from reach group by 1) left join n using (doc_id)"""

BYTE_STRINGS = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (select doc_id, i, substr(h, 2 * i + 1, 100) as g from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from h where len(h) >= 100)),
late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as first from windows) where first < doc_id),
runs as (select doc_id, min(i) as lo, max(i) + 50 as hi from (select *, sum(fresh) over (partition by doc_id order by i) as run from
 (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from late)) group by doc_id, run),
kept as (select doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' order by lo) as front, max(hi) as last, sum(hi - lo) as n, count(*) as spans from
 (select *, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as prev from runs) join h using (doc_id) group by 1)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(spans, 0) as n_spans,
 sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from h left join kept using (doc_id)"""

_TERMS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH = rf"""
with tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TERMS}) as term from documents) group by all),
n as (select doc_id, sum(tf)::bigint as n from tf group by 1),
total as (select count(*) as docs, sum(n)::bigint as terms from n),
q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, total where term in (select term from q) group by 1),
m as (select doc_id, 100 - 50 + (50 * n * docs) // terms as m from n, total),
scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from q join w using (term) join tf using (term) join m using (doc_id) group by all),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0)
select * from ranked where rank <= 50"""

INNER_PRODUCTS = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as c from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select q.vec_id as query_id, v.vec_id as vec_id, list_inner_product(q.c, v.c)::bigint as score from v q join v on v.vec_id <> q.vec_id where q.vec_id % 20 = 0),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scores)
select * from ranked where rank <= 20"""
