"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from revsync.llm import byte_bpe, cover_tree, decontaminate, jaccard_join, language_bits, licenses, mixing, pii_crf, prefix_trie, suffix_array, token_counts, turn_repair, url_filter
from revsync.llm.common import table

BPE = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
WEIGHTS = [5, 2, 1]
URL_RULES = [
    url_filter.UrlRule("allow", "org", "/"),
    url_filter.UrlRule("block", "example.org", "/es/"),
    url_filter.UrlRule("block", "example.org", "/en/1"),
    url_filter.UrlRule("allow", "com", "/fr/"),
    url_filter.UrlRule("block", "com", "/de/"),
]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a benchmark item's window of ten words."""
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contamination(docs, items).drop("n_near")


def op2_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with `n_near`, the proximity matches, which the check of op2_decontaminate leaves out."""
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contamination(docs, items)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by a byte-level BPE, and which documents have over 512."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path(BPE), public_tokenizers.PATTERN)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by five-word shingles of similarity 0.75 or more."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors linked by a cosine of 0.9 or more."""
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that an earlier one has."""
    return suffix_array.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by patterns and by a field trained on their finds."""
    docs = table(spark, sf_dir, "documents")
    return pii_crf.detect(docs, pii_crf.train(docs, "doc_id", "text"))


def op8_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by the longest rule, or by its aliases."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources by weight takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS)


def op10_language_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    learnt = docs.where(F.coalesce(~language_bits.held_out("doc_id"), F.lit(False)))
    filters = language_bits.fit(learnt, "text", "lang", F.col("doc_id"))
    got = language_bits.identify(docs, filters)
    return got.select("doc_id", F.coalesce(language_bits.held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by a byte-level BPE, and the bytes they decode to, as digests."""
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage."""
    rows = turn_repair.rows_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return turn_repair.report(rows, turn_repair.damaged(rows)).withColumnRenamed("conv", "conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a trie of all conversations, rebuilt to share beginnings."""
    return prefix_trie.rebuilt_nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_decontaminate, op2_proximity, op3_token_counts, op4_ngram_jaccard, op5_cover_tree, op6_suffix_dedup, op7_pii_crf, op8_url_redirects, op9_mix_sources, op10_language_bits, op11_byte_bpe, op12_turn_repair, op13_prefix_trie)
}

#: The table of a CRC-32 by bytes, and the CRC of an ASCII string by it.
CRC_TABLE = """
crc_bits(b, k, c) as (
  select b, 0, b::ubigint from range(256) t(b)
  union all
  select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from crc_bits where k < 8),
crc as (select list(c order by b) as steps from crc_bits where k = 8)"""


def crc32_sql(text: str) -> str:
    return f"""xor(4294967295::ubigint, list_reduce(
      list_concat([4294967295::ubigint], [ord(x)::ubigint for x in string_split({text}, '')]),
      lambda a, x: xor(steps[(xor(a, x) & 255)::int + 1], a >> 8)))"""


#: SQL that must give the same rows.
ORACLES: dict[str, str] = {
    "op2_decontaminate": r"""
with d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (
  select item_id::varchar as item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0),
win as (select distinct item, least(len(w), 10) as n, array_to_string(w[s:s + 9], ' ') as p from iw),
ns as (select distinct n from win),
dw as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, ns),
dp as (select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as p from dw),
hit as (select distinct dp.doc_id, dp.s, dp.n, win.item from dp join win on dp.p = win.p and dp.n = win.n),
cov as (
  select doc_id, count(distinct pos) as n_hit
  from (select doc_id, unnest(range(s, s + n)) as pos from hit) group by doc_id),
its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join cov on d.doc_id = cov.doc_id left join its on d.doc_id = its.doc_id
""",
    "op4_ngram_jaccard": r"""
with recursive d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
g as (
  select distinct doc_id, array_to_string(w[s:s + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as s from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
pair as (
  select x.doc_id as a, y.doc_id as b, count(*) as k
  from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
link as (
  select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) as (
  select doc_id, doc_id from d union select reach.a, link.b from reach join link on reach.b = link.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles,
  (select min(b) from reach where reach.a = d.doc_id) as component_id
from d left join n on n.doc_id = d.doc_id
""",
    "op5_cover_tree": r"""
with recursive v as (
  select vec_id, embedding::double[] as e, sqrt(list_sum([x * x for x in embedding::double[]])) as n
  from embeddings
  where embedding is not null
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0),
link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(a, b) as (
  select vec_id, vec_id from embeddings union select reach.a, link.b from reach join link on reach.b = link.a),
c as (select a, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from link where a = vec_id)::bigint as n_links, component_id,
  vec_id = component_id as kept
from embeddings join c on c.a = vec_id
""",
    "op8_url_redirects": r"""
with recursive rules(verdict, h, p) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
page as (
  select page_id, url, html, coalesce(url, '') as u from pages),
tag as (
  select url as a, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) as link,
    null as refresh from pages where url is not null
  union all
  select url, null, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'))
  from pages where url is not null),
target as (
  select a, regexp_replace(regexp_replace(
    coalesce(regexp_extract(link, '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1),
      regexp_extract(refresh, '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1)),
    '&#0*47;|&#x0*2f;|&sol;', '/', 'gi'), '&#0*38;|&#x0*26;|&amp;', '&', 'gi') as t from tag),
base as (
  select a, t, regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1) as site,
    regexp_extract(a, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as own,
    regexp_replace(regexp_extract(a, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as folder
  from target where t <> '' and not starts_with(t, '#')
    and (regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') or not regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:'))),
resolved as (
  select a, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t
    when starts_with(t, '//') then 'http:' || t when starts_with(t, '/') then site || t
    when starts_with(t, '?') then site || own || t
    else site || case when folder = '' then '/' else folder end || t end as b from base),
cut as (
  select a, b, regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1) as head,
    regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as p, regexp_extract(b, '(?s)^[^?#]*(.*)$', 1) as tail
  from resolved),
dots as (
  select *, string_split(substr(p, 2), '/') as segs from cut),
undotted as (
  select *, list_reduce(list_transform(segs, lambda x: [x]),
    lambda acc, x: case when x[1] = '..' then acc[1:len(acc) - 1] when x[1] = '.' then acc else acc || x end,
    []::varchar[]) as kept from dots),
link as (
  select a, case when regexp_matches(p, '(^|/)\.\.?(/|$)')
    then head || '/' || array_to_string(kept, '/')
      || case when segs[-1] in ('.', '..') and len(kept) > 0 then '/' else '' end || tail
    else b end as b from undotted),
urls as (select distinct u from (select u from page union all select a from link union all select b from link)),
part as (
  select u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
    split_part(case when regexp_matches(u, '(?s)^.*?://[^?#]*\?')
      then regexp_extract(u, '(?s)^.*?://[^?#]*\?([^#]*)', 1) else '' end, '#', 1) as q from urls),
kept as (
  select *, array_to_string([x for x in string_split(q, '&')
    if x <> '' and not regexp_full_match(x, '(utm_[^=]*|ref|fbclid|gclid|mc_[^=]*)(=.*)?')], '&') as k from part),
best as (
  select u, host, path,
    case when host <> '' then host || case when path = '' then '/' else path end
      || case when k = '' then '' else '?' || k end end as key,
    (select arg_max(struct_pack(rule := r.h || r.p, verdict := r.verdict), length(r.h || r.p)) from rules r
      where (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p)) as m from kept),
edge as (
  select distinct x.key as a, y.key as b from link join best x on link.a = x.u join best y on link.b = y.u
  where x.key is not null and y.key is not null),
pairs as (select a, b from edge union select b, a from edge),
reach(a, b) as (select a, a from pairs union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a),
aliased as (
  select reach.a, bool_or(m.verdict = 'allow') as allowed, bool_or(m.verdict = 'block') as blocked
  from reach join best on reach.b = best.key group by reach.a)
select page_id, host, path, m.rule as rule,
  coalesce(m.verdict, case when blocked and not coalesce(allowed, false) then 'block' end, 'allow') as verdict
from page join best on page.u = best.u left join aliased on best.key = aliased.a
""",
    "op9_mix_sources": r"""
with d as (
  select doc_id, source, md5(concat_ws(':', 'mix', doc_id::varchar)) as key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
    row_number() over (order by source asc nulls last) as rank from d group by source),
w as (
  select *, [5.0::double, 2.0::double, 1.0::double][((rank - 1) % 3 + 1)::int] as weight, source_size::double * 3 as cap from s),
c as (
  select *, cap / weight as reach,
    coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as weights,
    sum(source_size::double) over () as total from w),
l as (select *, (total - capped) / weights as level from c),
t as (
  select source, source_size,
    least(cap, case when reach > level then (select max(level) from l where reach > level) * weight else cap end) as target from l),
p as (
  select d.doc_id, d.size, t.source_size, t.target, round(t.target)::bigint as budget,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size
      rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken
from e
""",
}

ORACLES["op12_turn_repair"] = rf"""
with recursive {CRC_TABLE},
filled as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
  from conversations, crc),
hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) as copy
  from filled),
placed as (
  select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, left(role, 1) as initial,
    row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as place from hurt),
seen as (
  select *, lag(initial) over (partition by conv_id order by place) as before,
    row_number() over (partition by conv_id, role, text order by place) > 1 as again from placed),
told as (
  select *, case when bare = '' then 'blank' when again then 'duplicate'
    when right(bare, 1) not in ('.', '!', '?') then 'truncated' end as fault from seen),
turns as (
  select conv_id, list({{'doomed': coalesce(fault in ('blank', 'duplicate'), false), 'cut': (fault = 'truncated') is true, 'i': initial}} order by place) as t,
    list(role order by place) as roles, list(text order by place) as texts,
    coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from told group by conv_id),
-- per state (nothing yet, after system, after user, after assistant) the least (cost, audit) so far
step(conv_id, k, e, s, u, a) as (
  select conv_id, 0, {{'c': 0, 'x': ''}}, null::struct(c integer, x varchar), {{'c': 2, 'x': 'I'}}, {{'c': 4, 'x': 'II'}} from turns
  union all
  select conv_id, k, e, s, least_u, list_min([d_a, {{'c': least_u.c + 2, 'x': least_u.x || 'I'}}])
  from (
    select conv_id, k, e, s, d_a,
      list_min([x for x in [d_u, case when e is not null then {{'c': e.c + 2, 'x': e.x || 'I'}} end,
        case when s is not null then {{'c': s.c + 2, 'x': s.x || 'I'}} end, {{'c': d_a.c + 2, 'x': d_a.x || 'I'}}] if x is not null]) as least_u
    from (
      select st.conv_id, st.k + 1 as k, {{'c': st.e.c + 3, 'x': st.e.x || 'D'}} as e,
        list_min([x for x in [case when st.s is not null then {{'c': st.s.c + 3, 'x': st.s.x || 'D'}} end,
          case when not r.doomed and r.i = 's' then {{'c': st.e.c + r.cut::int, 'x': st.e.x || 'K'}} end] if x is not null]) as s,
        list_min([x for x in [{{'c': st.u.c + 3, 'x': st.u.x || 'D'}},
          case when not r.doomed then {{'c': st.e.c + r.cut::int + case when r.i = 'u' then 0 else 2 end, 'x': st.e.x || case when r.i = 'u' then 'K' else 'R' end}} end,
          case when not r.doomed and st.s is not null then {{'c': st.s.c + r.cut::int + case when r.i = 'u' then 0 else 2 end, 'x': st.s.x || case when r.i = 'u' then 'K' else 'R' end}} end,
          case when not r.doomed then {{'c': st.a.c + r.cut::int + case when r.i = 'u' then 0 else 2 end, 'x': st.a.x || case when r.i = 'u' then 'K' else 'R' end}} end] if x is not null]) as d_u,
        list_min([x for x in [{{'c': st.a.c + 3, 'x': st.a.x || 'D'}},
          case when not r.doomed then {{'c': st.u.c + r.cut::int + case when r.i = 'a' then 0 else 2 end, 'x': st.u.x || case when r.i = 'a' then 'K' else 'R' end}} end] if x is not null]) as d_a
      from (select step.*, t[k + 1] as r from step join turns on step.conv_id is not distinct from turns.conv_id where k < len(t)) st))),
best as (
  select step.conv_id, list_min([e, a]) as b from step join turns on step.conv_id is not distinct from turns.conv_id where k = len(t)),
ops as (
  select conv_id, b.x as audit, unnest(string_split(b.x, '')) as op, generate_subscripts(string_split(b.x, ''), 1) as nr from best where b.x <> ''),
lined as (
  select *, count(*) filter (op <> 'I') over w as place, count(*) filter (op <> 'D') over w as out
  from ops window w as (partition by conv_id order by nr)),
made as (
  select l.conv_id, l.out,
    case when op = 'K' then roles[place]
      when (l.out - (left(roles[first_place], 1) = 's' and first_op = 'K')::int) % 2 = 1 then 'user' else 'assistant' end
      || ':' || case when op = 'I' then '' else texts[place] end as line
  from (select *, first_value(place) over (partition by conv_id order by nr) as first_place,
      first_value(op) over (partition by conv_id order by nr) as first_op from lined where op <> 'D') l
  join turns on l.conv_id is not distinct from turns.conv_id),
mended as (select conv_id, sha256(string_agg(line, chr(10) order by out)) as h from made group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
  coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.x, '') as audit,
  coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join turns on c.conv_id is not distinct from turns.conv_id
left join best on c.conv_id is not distinct from best.conv_id
left join mended on c.conv_id is not distinct from mended.conv_id
"""
ORACLES["op13_prefix_trie"] = rf"""
with recursive {CRC_TABLE},
t as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
    md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as k, length(coalesce(text, '')) as n
  from conversations where conv_id is not null),
convs as (select c, {crc32_sql("c::varchar")} % 6 as h from (select distinct c from t), crc),
turns as (
  select convs.c, t.place, k, n from convs join t on t.c = convs.c - convs.c % 100 and place <= h
  union all
  select t.c, t.place, k, n from convs join t on t.c = convs.c and place > h),
paths as (
  select convs.c, coalesce(list(k order by place) filter (k is not null), []) as ks,
    coalesce(list(n order by place) filter (k is not null), []) as ns
  from convs left join turns on turns.c = convs.c group by convs.c),
prefixes as (
  select c, d, array_to_string(ks[1:d], ',') as p, array_to_string(ks[1:d - 1], ',') as up,
    case when d > 0 then ns[d] else 0 end as n, d = len(ks) as ends
  from (select *, unnest(range(0, len(ks) + 1)) as d from paths)),
node as (
  select d, p, any_value(up) as up, min(c) as c, count(*) as n_convs, any_value(n) as n,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256
  from prefixes group by d, p),
kids as (select d - 1 as d, up as p, count(*) as n_children from node where d > 0 group by 1, 2),
below as (
  select u.d, u.p, sum((v.n_convs - 1) * v.n) as saved, count(*) filter (kids.p is null) as n_leaves
  from node v join prefixes u on u.c = v.c and u.d <= v.d
  left join kids on kids.d = v.d and kids.p = v.p group by 1, 2)
select node.c as conv_id, node.d::bigint as depth, up.c as parent_conv_id, node.n_convs::bigint as n_convs,
  coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens,
  node.ends_sha256
from node join below on below.d = node.d and below.p = node.p
left join kids on kids.d = node.d and kids.p = node.p
left join node up on up.d = node.d - 1 and up.p = node.up and node.d > 0
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
