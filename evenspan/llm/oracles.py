"""SQL of the queries that SQL can state: op1, op2, op12 and op13. The others rest on hash draws, trained models or joins
that SQL is too slow for, and are tested against brute force in tests/llm."""

from __future__ import annotations

from . import hard_negatives as h
from . import quality as q
from . import spelling as sp
from .url_rules import SITE_RULES, WORD_RULES

SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def op1() -> str:
    return f"""
with d as (select doc_id, source, coalesce(text, '') t, row_number() over () rid from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) ls from d),
g as (select rid, i, list_aggregate(ws[i : i + 2], 'string_agg', ' ') gram from (select rid, ws, unnest(range(1, len(ws) - 1)) i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) c from g) where c > 1),
places as (select distinct rid, unnest([i, i + 1, i + 2]) p from twice),
covered as (select rid, count(*) n from places group by 1),
m as (
  select w.rid, doc_id, source, len(ws)::bigint n_words,
    length(regexp_replace(t, '{SPACE}', '', 'g'))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    len(ls) n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words
  from w left join covered c on w.rid = c.rid),
b as (select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words base_failed from m),
f as (select *, base_failed or n_symbols > {q.MAX_SYMBOL_SHARE}::double * word_chars or n_dup_lines > {q.MAX_DUP_LINE_SHARE}::double * n_lines failed from b),
h as (select source, count(*) n, sum(failed::int)::double k from f group by 1),
s0 as (select least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) mu, coalesce(var_samp(k / n), 0) var, avg(1.0::double / n) inv from h),
s1 as (select mu, var - mu * (1 - mu) * inv between_var from s0),
s as (select mu, case when between_var > 0 then least(greatest(mu * (1 - mu) / between_var - 1, 1.0), 1e6) else 1e6 end strength from s1),
r as (select source, (k + mu * strength) / (n + strength) rate from h, s)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not rate > {q.REJECT_RATE} and (not failed or rate <= {q.TRUST_RATE}) kept
from f join r on f.source is not distinct from r.source"""


def op2() -> str:
    sites = ", ".join(f"('{r.name}', '{r.verdict}', '{r.name.rpartition('/')[0].split('/', 1)[0]}', '/{r.name.split('/', 1)[1]}', {len(r.name)})" for r in SITE_RULES)
    words = " or ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in WORD_RULES)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with p as (select page_id, row_number() over () rid,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{upper}', '{upper.lower()}'), '') host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') path from pages),
rules(rule, verdict, site, start, weight) as (values {sites}),
hit as (select rid, arg_max(rule, weight) rule, arg_max(verdict, weight) verdict from p join rules
    on (host = site or host like '%.' || site) and path like start || '%' group by rid)
select page_id, host, path, rule, coalesce(verdict, case when {words} then 'block' else 'allow' end) verdict
from p left join hit on p.rid = hit.rid"""


def op12() -> str:
    return f"""
with v as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) q
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, r.vec_id other, a.label = r.label same, list_dot_product(a.q::double[], r.q::double[])::bigint score
  from v a join v r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other positive_id, score positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= {h.POSITIVES})
select anchor_id, positive_id, (row_number() over w)::int "rank", other negative_id, positive_score, score negative_score
from p join s using (anchor_id)
where not same and {h.LEAST_PERCENT} * positive_score <= 100 * score and score <= positive_score
window w as (partition by anchor_id, positive_id order by score desc, other)
qualify row_number() over w <= {h.NEGATIVES}"""


def op13() -> str:
    letters = "A-Za-z\u00c0-\u00ff"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive bits(i, k, v) as (select i, 0, i from range(256) r(i)
    union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) tab from bits where k = 8),
runs as (select doc_id, translate(r, '{upper}', '{upper.lower()}') run, count(*) n
  from (select doc_id, unnest(regexp_extract_all(text, '[{letters}]+')) r from documents) group by all),
named as (select *, list_transform(string_split(doc_id::varchar || ':' || run, ''), lambda x: case when ord(x) < 128 then [ord(x)] else [195, ord(x) - 64] end) bytes
  from runs where length(run) >= {sp.LEAST_LETTERS}),
summed as (select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(bytes)::bigint[]), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) h from named, crc),
less as (select n, case when h % {sp.CUT} = 0 then run[: h % length(run)] || run[h % length(run) + 2 :] else run end word from summed),
w as (select word, sum(n)::bigint n from less where length(word) >= {sp.LEAST_LETTERS} group by 1 having sum(n) >= {sp.LEAST_COUNT}),
d as (select word, i, word[: i] || word[i + 2 :] rest from (select word, unnest(range(length(word))) i from w)),
one as (select word, rest near from d where rest in (select word from w)
  union select rest, word from d where rest in (select word from w)
  union select a.word, b.word from d a join d b on a.i = b.i and a.rest = b.rest and a.word <> b.word),
best as (select one.word, count(*) n_near, arg_min(near, (-w.n, near)) near, max(w.n) near_n from one join w on w.word = one.near group by 1),
f as (select w.word, w.n, coalesce(n_near, 0) n_near, case when near_n >= {sp.TIMES} * w.n then near end form, case when near_n >= {sp.TIMES} * w.n then near_n end form_n
  from w left join best on w.word = best.word),
up as (select word, form, 1 k from f where form is not null union all select up.word, f.form, k + 1 from up join f on up.form = f.word where f.form is not null),
top as (select word, arg_max(form, k) root from up group by 1)
select f.word, form, coalesce(root, f.word) root, n, n_near, form_n from f left join top on f.word = top.word"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1(), "op2_url_filters": op2(), "op12_hard_negatives": op12(), "op13_spelling": op13()}
