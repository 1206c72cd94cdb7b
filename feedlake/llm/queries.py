"""The registered queries of this subpackage."""

from __future__ import annotations

from . import bytebpe, decontaminate, hardneg, langid, mixing, neighbours, pages, phrases, quality, repeats, secrets, similar, wavelet

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_jaccard_join": similar.op2_jaccard_join,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_language_id": langid.op4_language_id,
    "op5_quality": quality.op5_quality,
    "op6_nearest_neighbours": neighbours.op6_nearest_neighbours,
    "op7_main_text": pages.op7_main_text,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_remove_repeats": repeats.op9_remove_repeats,
    "op10_token_output": wavelet.op10_token_output,
    "op11_byte_bpe": bytebpe.op11_byte_bpe,
    "op12_phrases": phrases.op12_phrases,
    "op13_hard_negatives": hardneg.op13_hard_negatives,
}

_OP2 = r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 85 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
select doc_id, coalesce(n, 0) as n_shingles, c as component_id from (select a as doc_id, min(b) as c from r group by a) left join n using (doc_id)"""

_OP6 = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s qualify rank <= 20"""

_OP9 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, substr(x, 2 * i + 1, 100) as s from (select doc_id, x, unnest(range(0, n - 49)) as i from d where n >= 50)),
r as (select doc_id, i from w join (select s, min(doc_id) as f from w group by s) using (s) where doc_id > f),
g as (select *, sum(case when i - before <= 50 then 0 else 1 end) over (partition by doc_id order by i) as span from (select *, lag(i) over (partition by doc_id order by i) as before from r)),
t as (select doc_id, min(i) as lo, max(i) + 50 as hi from g group by doc_id, span),
b as (select doc_id, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as a, lo as z, hi - lo as gone from (select * from t union all select doc_id, n, n from d)),
k as (select doc_id, sum(gone) as n_removed, count(*) - 1 as n_spans, string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' order by z, gone) as kept from b join d using (doc_id) group by doc_id)
select doc_id, n as n_bytes, cast(n_removed as bigint) as n_removed, n_spans, sha256(unhex(kept)) as kept_sha256 from k join d using (doc_id)"""

_OP8 = r"""with a as (select distinct 'd' as side, doc_id as id, coalesce(text, '') as text from documents union all select distinct 'b', item_id, coalesce(text, '') from benchmark),
b as (select side, id, text, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '([0-9])[.,]([0-9])', '\1\2', 'g'), '([0-9])[.,]([0-9])', '\1\2', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '') as raw from a),
t as (select row_number() over () as r, side, id, raw, list_transform(raw, lambda x: lower(x)) as plain, list_transform(raw, lambda x: case when x[1] between '0' and '9' then '#number' when lower(x) in (UNITS) then '#unit' when length(x) > 1 and x[1] <> lower(x)[1] and x[2] = lower(x)[2] then '#name' else lower(x) end) as template from b),
i as (select *, least(len(raw), WINDOW) as n from t where side = 'b' and len(raw) > 0),
p as (select *, unnest(range(1, len(raw) - n + 2)) as pos from i),
e as (select *, len(list_filter(template[pos:pos + n - 1], lambda x: x[1] <> '#')) < LITERALS as exact from p),
w as (select id as item_id, r as item, n, exact, pos, array_to_string((case when exact then plain else template end)[pos:pos + n - 1], ' ') as h, count(*) over (partition by id) as item_windows, count(*) filter (not exact) over (partition by id) as item_templates from e),
k as (select distinct n, exact from w),
l as (select r, n, exact, case when exact then plain else template end as x from t, k where side = 'd' and len(raw) >= n),
g as (select r, n, exact, unnest(list_transform(range(1, len(x) - n + 2), lambda j: {'at': j, 'h': array_to_string(x[j:j + n - 1], ' ')})) as v from l),
m as (select g.r, item, item_id, item_windows, item_templates, exact, n, pos, v.at as place, v.at - pos as shift from g join w using (n, exact) where v.h = w.h),
z as (select m.*, unnest(range(0, n)) as j from m where not exact),
s as (select z.r, z.item_id, shift, y.template[pos + j] as kind, y.plain[pos + j] as item_value, x.plain[place + j] as doc_value from z join t x on z.r = x.r join t y on z.item = y.r where y.template[pos + j][1] = '#'),
o as (select r, item_id, shift, count(*) as slots, count(*) filter (same) as fits from (select r, item_id, shift, min(doc_value) = max(doc_value) as same from s group by r, item_id, shift, kind, item_value) group by all),
c as (select distinct m.r, m.item_id, item_windows, item_templates, exact, pos, coalesce(slots, 0) as slots, coalesce(fits, 0) as fits from m left join o using (r, item_id, shift) where coalesce(fits, 0) >= cast(CONSISTENT as double) * coalesce(slots, 0)),
f as (select r, item_id, item_windows, item_templates, count(distinct (pos, exact)) as windows, count(distinct pos) filter (not exact) as templates, max(slots) as slots, max(fits) as fits from c group by all),
u as (select *, item_templates > 0 and templates * item_windows > windows * item_templates as alone from f),
q as (select r, item_id, case when alone then templates else windows end as windows, case when alone then item_templates else item_windows end as item_windows, slots, fits from u)
select t.id as doc_id, item_id, windows, item_windows, windows / item_windows as coverage, slots, fits as consistent_slots from q join t using (r) where windows / item_windows >= cast(COVERAGE as double)"""
for _name in ("WINDOW", "LITERALS", "CONSISTENT", "COVERAGE"):
    _OP8 = _OP8.replace(_name, str(getattr(decontaminate, _name)))
_OP8 = _OP8.replace("UNITS", ", ".join(f"'{u}'" for u in decontaminate.UNITS))

_OP12 = r"""with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') as ws from d),
c as (select lang, sum(len(ws)) as n from p group by lang),
g as (select lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: {'k': k, 's': array_to_string(ws[i:i + k - 1], ' ')})))) as v from p),
f as (select lang, v.k as words, v.s as phrase, count(*) as a from g group by all having count(*) >= 100),
w as (select *, string_split(phrase, ' ') as ws from f),
gone as (select distinct lang, unnest([array_to_string(ws[1:words - 1], ' '), array_to_string(ws[2:words], ' ')]) as phrase, a from w where words > 2),
cand as (select * from w where words > 1 and not exists (select 1 from gone where gone.lang = w.lang and gone.phrase = w.phrase and gone.a = w.a)),
cut as (select lang, phrase, a, ws, words, unnest(range(1, words)) as k from cand),
s as (select cut.lang, cut.phrase, cut.a, x.a as l, y.a as r, c.n, k, (1000::hugeint * cut.a * c.n) // (x.a::hugeint * y.a) as score from cut join f x on x.lang = cut.lang and x.phrase = array_to_string(ws[1:k], ' ') join f y on y.lang = cut.lang and y.phrase = array_to_string(ws[k + 1:cut.words], ' ') join c on c.lang = cut.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as integer) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from b qualify rank <= 2000"""

_OP13 = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as same, cast(list_inner_product(a.e, c.e) as bigint) as score from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as integer) as rank, id as negative_id, positive_score, score as negative_score from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score qualify rank <= 10"""

#: DuckDB SQL, where it can express the operator.
ORACLE_SQL: dict[str, str] = {"op2_jaccard_join": _OP2, "op6_nearest_neighbours": _OP6, "op8_decontaminate": _OP8, "op9_remove_repeats": _OP9, "op12_phrases": _OP12, "op13_hard_negatives": _OP13}
