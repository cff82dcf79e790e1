"""SQL for the queries of this subpackage, over whole tables."""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with item as (
  select item_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') as w
  from benchmark where item_id is not null and text is not null
), win as (
  select distinct item_id, least(10, len(w)) as k, list_slice(w, i, i + least(10, len(w)) - 1) as win
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from item where len(w) > 0)
), doc as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}'), []) as w
  from documents
), met as (
  select d.rid, d.i, win.k, win.item_id
  from (select rid, w, unnest(range(1, len(w) + 1)) as i from doc) d
  join (select distinct k from win) ks on d.i + ks.k - 1 <= len(d.w)
  join win on win.k = ks.k and win.win = list_slice(d.w, d.i, d.i + ks.k - 1)
), hit as (
  select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from met) group by rid
), ids as (
  select rid, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct rid, cast(item_id as varchar) as id from met) group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (rid) left join ids using (rid)
"""

OP4 = rf"""
with recursive doc as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_SPACED}'), []) as w
  from documents
), shingle as (
  select distinct rid, list_slice(w, i, i + least(5, len(w)) - 1) as s
  from (select rid, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from doc where len(w) > 0)
), size as (select rid, count(*) as n from shingle group by rid),
keyed as (select rid, s, count(*) over (partition by s) as df from shingle),
link as (
  select a.rid as a, b.rid as b
  from keyed a join keyed b on a.s = b.s and a.rid <> b.rid and a.df > 1 and b.df > 1
  join size na on na.rid = a.rid join size nb on nb.rid = b.rid
  where 4 * na.n >= 3 * nb.n and 4 * nb.n >= 3 * na.n
  group by a.rid, b.rid, na.n, nb.n
  having 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach as (
  select rid, rid as other from doc
  union
  select r.rid, l.b from reach r join link l on l.a = r.other
)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, c.component_id
from doc d left join size s using (rid)
join (select r.rid, min(o.doc_id) as component_id from reach r join doc o on o.rid = r.other group by r.rid) c using (rid)
"""

OP5 = rf"""
with doc as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{_SPACED}')), 0) as size,
         md5('mix-1|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) as key
  from documents
), src as (
  select *, cast((place - 1) % 3 + 1 as bigint) as weight from (
    select source, cast(sum(size) as bigint) as s, row_number() over (order by source nulls last) as place from doc group by source)
), tot as (select cast(coalesce(sum(s), 0) as bigint) as words, cast(coalesce(sum(weight), 0) as bigint) as weights from src),
fill as (
  select src.*, words, row_number() over o as turn,
         cast(words - 3 * coalesce(sum(s) over (o rows between unbounded preceding and 1 preceding), 0) as bigint) as left_words,
         cast(weights - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) as bigint) as left_weights
  from src, tot window o as (order by s / weight, place)
), free as (
  select turn as free_turn, left_words as fw, left_weights as fg from fill
  where not (weight * left_words > 3 * s * left_weights) order by turn limit 1
), tgt as (
  select source, place, s, words,
         case when turn < free_turn then cast(3 * s as double) else cast(weight * fw as double) / fg end as target
  from fill, free
), laid as (
  select d.doc_id, d.size, t.s, t.target, cast(round(t.target) as bigint) as w,
         cast(coalesce(sum(d.size) over (partition by t.place order by d.key rows between unbounded preceding and 1 preceding), 0) as bigint) as a
  from doc d join tgt t on d.source is not distinct from t.source
)
select doc_id, cast(size as bigint) as size, cast(s as bigint) as source_size, target,
       cast(case when s = 0 then 0 else size * (w // s) + greatest(0, least(a + size, w % s) - a) end as bigint) as taken
from laid
"""

OP6 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, t, r, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)
), f as (
  select *, length(role) + length(text) + 24
         + len(regexp_extract_all(text, '<\\*\|'))
           * cast(text like '%<|%' or regexp_matches(text, '<\\+\|') as integer) as n from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(n) as bigint) as formatted_chars
from f group by conv_id
"""

OP9 = """
with v as (
  select row_number() over () as uid, vec_id as id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.uid, q.id as query_id, c.id as vec_id,
         cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.id % 100 = 0 and q.uid <> c.uid and len(q.v) = len(c.v)
)
select query_id, cast(rank as integer) as rank, vec_id, coalesce(score, 0) as score from (
  select *, row_number() over (partition by uid order by score desc, vec_id) as rank from s) where rank <= 10
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = rf"""
with doc as (
  select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_TERM}') as w
  from documents where text is not null
), item as (
  select row_number() over () as iid, item_id, regexp_extract_all({_LOWER.format('text')}, '{_TERM}') as w
  from benchmark where text is not null
), asked as (select iid, t, count(*) as c from (select iid, unnest(w) as t from item) group by iid, t),
total as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_terms from doc where len(w) > 0),
held as (
  select rid, t, count(*) as tf from (select rid, unnest(w) as t from doc) where t in (select t from asked) group by rid, t
), weight as (
  select t, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double)) as bigint) as w
  from (select t, count(*) as df from held group by t), total
), size as (
  select rid, doc_id, 75 + (25 * len(w) * n_docs) // n_terms as m from doc, total where len(w) > 0
), score as (
  select iid, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from asked join held using (t) join weight using (t) join size using (rid) group by iid, rid, doc_id
)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select *, row_number() over (partition by iid order by score desc, doc_id nulls last) as rank from score where score > 0
) join item using (iid) where rank <= 20
"""

OP12 = """
with doc as (
  select row_number() over () as rid, doc_id, coalesce(encode(text), ''::blob) as b from documents
), start as (
  select rid, p, md5(b[p:p + 199]) as g
  from (select rid, b, unnest(range(1, octet_length(b) - 198)) as p from doc where octet_length(b) >= 200)
), hit as (
  select rid, p from (select rid, p, count(*) over (partition by g) as n from start) where n > 1
), run as (
  select rid, min(p) as a, max(p) + 200 as e from (
    select rid, p, sum(fresh) over (partition by rid order by p) as r from (
      select rid, p, case when p > lag(p) over (partition by rid order by p) + 200 then 1 else 0 end as fresh from hit))
  group by rid, r
), gap as (
  select rid, a, e, coalesce(lag(e) over (partition by rid order by a), 1) as since from run
), cut as (
  select rid, sum(e - a) as n_removed, count(*) as n_spans, max(e) as last,
         string_agg(hex(b[since:a - 1]), '' order by a) as head
  from gap join doc using (rid) group by rid
)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(case when cut.rid is null then b else unhex(head || hex(b[last:octet_length(b)])) end) as kept_sha256
from doc left join cut using (rid)
"""

_STEP = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"
_CRC = "lambda c, x: xor(c // 256, crc[cast(xor(c, x) % 256 as integer) + 1])"

OP13 = rf"""
with recursive byte as (
  select i, 0 as k, i::bigint as c from range(256) t(i)
  union all
  select i, k + 1, {_STEP} from byte where k < 8
), tab as (select list(c order by i) as crc from byte where k = 8),
run as (
  select coalesce(cast(doc_id as varchar), '') || ':' || r as s, r, count(*) as n from (
    select doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[A-Za-zÀ-ÿ]+')) as r
    from documents where text is not null) group by doc_id, r
), hashed as (
  select r, n, xor(list_reduce(
    list_transform(range(1, octet_length(encode(s)) + 1), lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::bigint),
    {_CRC}, 4294967295::bigint), 4294967295::bigint) as h
  from run, tab
), word as (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 97 = 0 then substr(r, 1, cast(h % length(r) as integer)) || substr(r, cast(h % length(r) as integer) + 2)
                else r end as word, n from hashed)
  where length(word) >= 5 group by word having sum(n) >= 3
), less as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as s
  from (select word, n, unnest(range(1, length(word) + 1)) as i from word)
), pair as (
  select a.word, b.word as near, b.n as near_n from less a join less b on a.s = b.s and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from less a join word b on a.s = b.word
  union select b.word, a.word, a.n from less a join word b on a.s = b.word
), best as (
  select word, count(*) as n_near, max(near_n) as best_n, arg_min(near, (-near_n, near)) as near from pair group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near,
         case when best_n >= 2 * w.n then near end as form, case when best_n >= 2 * w.n then best_n end as form_n
  from word w left join best b on b.word = w.word
), chain as (
  select word, coalesce(form, word) as stop, 0 as d from formed
  union all
  select c.word, f.form, d + 1 from chain c join formed f on f.word = c.stop where f.form is not null
), ending as (select word, arg_max(stop, d) as root from chain group by word)
select f.word, f.form, e.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n from formed f join ending e on e.word = f.word
"""

ORACLES = {"op1_decontamination": OP1, "op4_jaccard_join": OP4, "op5_mixing": OP5, "op6_chat": OP6, "op9_cover_tree": OP9, "op11_bitsliced": OP11, "op12_suffixes": OP12, "op13_spelling": OP13}
