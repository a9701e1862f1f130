"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import format_chats
from .cluster import table
from .decontamination import decontaminate
from .html_text import extract
from .langid import identify
from .near_dups import group
from .packing import pack
from .quality import judge
from .resampling import resample
from .suffixes import remove_repeats
from .toxicity import score


def op1_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}

SQL = {}
SQL["op1_decontamination"] = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark where text is not null and item_id is not null),
iw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') as s from (select item_id, w, unnest(range(1, greatest(2, len(w) - 11))) as p from i where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select r, p, n, array_to_string(w[p:p + n - 1], ' ') as s from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
hits as (select r, item_id, p, dw.n from dw join iw on dw.n = iw.n and dw.s = iw.s),
covered as (select r, count(distinct x) as n_hit from (select r, unnest(range(p, p + n)) as x from hits) group by r),
named as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, cast(item_id as varchar) as id from hits) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
 sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join covered using (r) left join named using (r)
"""


def op7_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return format_chats(rows.unionByName(more)).drop("n_tokens", "n_loss_tokens")


def op10_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES |= {"op7_chat_formatting": op7_chat_formatting, "op10_best_fit_packing": op10_best_fit_packing}
SQL["op7_chat_formatting"] = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t as (select *, length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g')) as n_text, length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g')) as n_role from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(n_text + n_role + length('<|start|>') + 1 + length('<|end|>') + 1) as bigint) as formatted_chars
from t group by conv_id
"""


def op8_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).drop("posterior")


QUERIES |= {"op8_quality_rules": op8_quality_rules}
SQL["op8_quality_rules"] = r"""
with recursive d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, p, array_to_string(w[p:p + 4], ' ') as k from (select r, w, unnest(range(1, len(w) - 3)) as p from w where len(w) >= 5)),
rep as (select r, count(distinct x) as n from (select r, unnest(range(p, p + 5)) as x from (select r, p, count(*) over (partition by r, k) as n from g) where n > 1) group by r),
c as (select r, doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, len(l) as n_lines,
 len(regexp_extract_all(t, '\p{Lu}')) as n_upper, len(regexp_extract_all(t, '[.?!]')) as n_sentence_ends, len(regexp_extract_all(t, '!')) as n_exclaims from w left join rep using (r)),
v as (select *, [case when n_words < 40 then -1 when n_words >= 50 then 1 else 0 end,
 case when 10 * n_repeat_words > n_words then -1 when 20 * n_repeat_words <= n_words and n_words >= 20 then 1 else 0 end,
 case when 20 * n_symbols > n_words then -1 when 100 * n_symbols <= n_words and n_words >= 20 then 1 else 0 end,
 case when word_chars < 3 * n_words or word_chars > 10 * n_words then -1 when word_chars between 4 * n_words and 8 * n_words and n_words >= 20 then 1 else 0 end,
 case when 5 * n_dup_lines > n_lines then -1 when n_dup_lines = 0 and n_lines >= 2 then 1 else 0 end,
 case when 5 * n_upper > word_chars then -1 when 20 * n_upper <= word_chars and n_words >= 20 then 1 else 0 end,
 case when n_words >= 30 and 60 * n_sentence_ends < n_words or n_words >= 20 and 4 * n_sentence_ends > n_words then -1 when 40 * n_sentence_ends >= n_words and 5 * n_sentence_ends <= n_words and n_words >= 20 then 1 else 0 end,
 case when 2 * n_exclaims > n_sentence_ends then -1 when 10 * n_exclaims <= n_sentence_ends and n_words >= 20 then 1 else 0 end] as v from c),
ps as (select v, count(*) as n from v group by v),
cells as (select ps.v as pattern, n, j, ps.v[j] as vote from ps, (select unnest(range(1, 9)) as j)),
m as (
 select 0 as step, k, case when k = 0 then 0.85::double else 0.15::double / 8 end as share, [case when k = 0 then 0.02::double when j = k then 0.8::double else 0.1::double end for j in range(1, 9)] as bad from (select unnest(range(0, 9)) as k)
 union all
 select any_value(step) + 1, k, any_value(share), list((hit + case when k = 0 then 0.02 * heavy else 1 end) / (voted + case when k = 0 then heavy else 2 end) order by j) from (
  select step, k, j, any_value(share) as share, sum(q * n) filter (vote = -1) as hit0, coalesce(sum(q * n) filter (vote = -1), 0) as hit, coalesce(sum(q * n) filter (vote <> 0), 0) as voted, 100 + 0.5 * any_value(total) as heavy from (
   select e.*, cells.j, cells.vote, (sum(case when cells.j = 1 then e.q * e.n else 0 end) over (partition by e.k) + 1) / (e.total + 9) as share from (
    select step, pattern, n, k, p / sum(p) over (partition by pattern) as q, (select count(*) from v) as total from (
     select any_value(step) as step, pattern, any_value(n) as n, k, exp(ln(any_value(share)) + sum(case vote when -1 then ln(bad[j]) when 1 then ln(1 - bad[j]) else 0 end)) as p from m, cells where step < 60 group by pattern, k)) e join cells on cells.pattern = e.pattern) group by step, k, j) group by k),
l as (select * from m where step = 60),
post as (select v, sum(p) filter (k = 0) / sum(p) as good from (select v, k, exp(ln(share) + list_sum([case v[j] when -1 then ln(bad[j]) when 1 then ln(1 - bad[j]) else 0 end for j in range(1, 9)])) as p from ps, l) group by v)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
 n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and good >= 0.5 as kept from v join post using (v)
"""


def op4_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


QUERIES |= {"op4_language_id": op4_language_id}


def op3_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES |= {"op3_importance_resampling": op3_importance_resampling, "op5_toxicity": op5_toxicity}


def op6_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), stable=True)


QUERIES |= {"op6_suffix_dedup": op6_suffix_dedup}
SQL["op6_suffix_dedup"] = r"""
with d as (select row_number() over () as r, doc_id, text is null as none, hex(encode(coalesce(text, ''))) as h from documents),
c as (select r, base, length(h) // 2 - 399 - base as n, substr(h, 2 * base + 1, 2 * (512 + 399)) as part from (select r, h, unnest(range(0, length(h) // 2 - 399, 512)) as base from d where length(h) >= 800)),
w as (select r, base + q as p, md5(substr(part, 2 * q + 1, 800)) as k from (select r, base, part, unnest(range(0, least(n, 512))) as q from c)),
s as (select r, p from (select r, p, count(*) over (partition by k) as n from w) where n > 1),
n as (select r, p, case when p > lag(p) over (partition by r order by p) + 400 then 1 else 0 end as new from s),
i as (select r, p, sum(new) over (partition by r order by p) as island from n),
g as (select r, min(p) as a, max(p) + 400 as e from i group by r, island),
o as (select r, a, e, lag(e, 1, 0) over (partition by r order by a) as before from g),
k as (select r, count(*) as n_spans, sum(e - a) as n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(e) + 1) as kept from o join d using (r) group by r),
f as (select doc_id, none, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(kept, h) as kept from d left join k using (r))
select doc_id, cast(n_bytes as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, cast(n_spans as bigint) as n_spans, sha256(unhex(kept)) as kept_sha256,
 case when not none then decode(unhex(regexp_replace(kept, '([0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9A-CEF][89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[123][89AB].[89AB].[89AB].|F48.[89AB].[89AB].)|..', '\1', 'g'))) end as text
from f
"""


def op2_minhash_near_dedup(spark, sf_dir):
    return group(table(spark, sf_dir, "documents"), stable=True)


QUERIES |= {"op2_minhash_near_dedup": op2_minhash_near_dedup}
SQL["op2_minhash_near_dedup"] = r"""
with recursive d as (select distinct doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[p:p + 4], ' ') end as g, least(5, len(w)) as k from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.k = b.k and a.doc_id < b.doc_id group by all),
l as (select a, b from e join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
u as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from d union select r.a, u.b from r join u on r.b = u.a),
m as (select a as doc_id, min(b) as component_id from r group by a)
select documents.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, documents.doc_id = component_id as kept from documents join m using (doc_id) left join n using (doc_id)
"""


def op9_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES |= {"op9_html_extraction": op9_html_extraction}
