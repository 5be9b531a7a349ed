"""DuckDB SQL for the rows of op1, op8, op10 and op11 to op13, over whole tables."""

from __future__ import annotations

from forgecast.llm import licenses as L
from forgecast.llm import quality as Q

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _gram(n: int) -> str:
    """The n words from one on, as one text; null where fewer follow."""
    words = ", ".join(f"lead(word, {k}) over o" for k in range(1, n))
    return f"case when i + {n - 1} <= n then concat_ws(' ', word, {words}) end"


def quality_sql() -> str:
    sizes = list(Q.GRAM_LIMITS)
    grams = ", ".join(f"{_gram(n)} as g{n}" for n in sizes)
    twice = ", ".join(f"(g{n} is not null and count(*) over (partition by r, g{n}) > 1)::int as t{n}"
                      for n in sizes)
    covered = ", ".join(f"max(t{n}) over (partition by r order by i rows {n - 1} preceding) as v{n}"
                        for n in sizes)
    chars = ", ".join(f"sum(c * v{n})::bigint as rep{n}_chars" for n in sizes)
    shares = " and ".join(f"100 * rep{n}_chars <= {limit} * word_chars"
                          for n, limit in Q.GRAM_LIMITS.items())
    zero = ", ".join(f"coalesce(rep{n}_chars, 0)::bigint as rep{n}_chars" for n in sizes)
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
ws as (select r, regexp_extract_all(text, {_WORDS}) as ws from d),
w as (select r, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as i from ws),
g as (select r, i, length(word) as c, {grams} from w window o as (partition by r order by i)),
t as (select r, i, c, {twice} from g),
v as (select r, c, {covered} from t),
s as (select r, count(*) as n_words, sum(c)::bigint as word_chars,
        sum(v5)::bigint as n_repeat_words, {chars} from v group by r),
ls as (select r, string_split(text, chr(10)) as ls from d),
l as (select r, unnest(ls) as line, generate_subscripts(ls, 1) as i from ls),
e as (select r, line, row_number() over (partition by r, line order by i) > 1 as later from l
      where regexp_matches(line, {_WORDS})),
x as (select r, count(*) as n_dup_lines,
        sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))::bigint as dup_line_chars
      from e where later group by r),
f as (select doc_id, coalesce(n_words, 0)::bigint as n_words,
        coalesce(word_chars, 0)::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        coalesce(dup_line_chars, 0)::bigint as dup_line_chars, {zero}
      from d left join s using (r) left join x using (r)),
b as (select *, n_words < {Q.MIN_WORDS} or 100 * n_repeat_words > {Q.REPEAT_WORDS_LIMIT} * n_words
        as base_failed from f)
select *, not base_failed and {shares}
  and 100 * dup_line_chars <= {Q.LINE_LIMIT} * word_chars as kept from b"""


def license_sql() -> str:
    phrases = [(p.split(), label) for p, label in L.BASE_PHRASES.items()]
    longest = max(len(p) for p, _ in phrases)
    leads = ", ".join(f"lead(word, {k}) over o as w{k}" for k in range(1, longest))
    base = " union all ".join(
        f"select r, i, '{label}' as label from g where word = '{p[0]}'"
        + "".join(f" and w{k} = '{x}'" for k, x in enumerate(p) if k) for p, label in phrases)
    pairs = L.templates(L.NOTICES)
    notices = ", ".join(
        f"({t}, '{label}', {L.block_words(len(text.split()), L.THRESHOLD)}, '{word}')"
        for t, (label, text) in enumerate(pairs) for word in sorted(set(text.split())))
    return rf"""
with d as (select row_number() over () as r, doc_id, {_folded('text')} as text from documents),
ws as (select r, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from d),
w as (select r, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from ws),
g as (select r, i, word, {leads} from w window o as (partition by r order by i)),
p as ({base}),
b as (select r, count(*) as n_base, min(i)::bigint as first_word, max(i)::bigint as last_word,
        string_agg(distinct label, ',' order by label) as base_labels from p group by r),
notice(t, label, block, word) as (values {notices}),
m as (select t, label, count(*) as m from notice group by all),
o as (select r, t, label, block, word, i from w join notice using (word)),
x as (select r, t, label, i as s, max(i) over k as e, count(distinct word) over k as c from o
      window k as (partition by r, t, label order by i range between current row and block - 1 following)),
h as (select r, label, s, e, c::double / m as share from x join m using (t, label)
      where c >= ceil({L.THRESHOLD} * m - 1e-9)),
best as (select r, label, share from h where not exists (select 1 from h b where b.r = h.r
      and b.label <> h.label and b.share > h.share
      and 2 * (least(h.e, b.e) - greatest(h.s, b.s) + 1) > h.e - h.s + 1)),
score as (select r, max(share) as score from best group by r),
u as (select r, string_agg(distinct label, ',' order by label) as labels
      from (select r, label from best union all select r, label from p) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word,
  last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then 1.0 else coalesce(score, 0.0) end::double as score
from d join ws using (r) left join b using (r) left join u using (r) left join score using (r)"""


def _links_sql() -> str:
    """Common tables up to ``links``: both directions of every pair at the threshold."""
    leads = ", ".join(f"lead(word, {k}) over o" for k in range(1, 5))
    return rf"""
ws as (select doc_id, regexp_extract_all({_folded('text')}, {_WORDS}) as ws from documents),
w as (select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as i from ws),
g as (select doc_id, case when i + 4 <= n then concat_ws(' ', word, {leads}) end as shingle
      from w window o as (partition by doc_id order by i)),
s as (select distinct doc_id, shingle from g where shingle is not null
      union all select doc_id, array_to_string(ws, ' ') from ws where len(ws) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select x.doc_id as a, y.doc_id as b, count(*) as shared
         from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by all),
links as (select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b
          where 100 * shared >= 80 * (na.n + nb.n - shared))"""


def ngram_join_sql() -> str:
    return rf"""
with recursive {_links_sql()},
reach as (select a as x, a as y from links
          union select reach.x, links.b from reach join links on links.a = reach.y),
least as (select x, min(y) as y from reach group by x)
select ws.doc_id, coalesce(n.n, 0)::bigint as n_shingles,
  coalesce(least.y, ws.doc_id)::bigint as component_id
from ws left join n on n.doc_id = ws.doc_id left join least on least.x = ws.doc_id"""


def ngram_links_sql() -> str:
    return rf"""
with {_links_sql()},
linked as (select a, count(*) as n from links group by a)
select ws.doc_id, coalesce(linked.n, 0)::bigint as n_links
from ws left join linked on linked.a = ws.doc_id"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text expression."""
    return f"""xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda y: ascii(y)::bigint),
  lambda c, y: list_reduce(range(8), lambda b, k: xor(b >> 1, 3988292384 * (b & 1)), xor(c, y)), 4294967295::bigint))"""


def merkle_sql() -> str:
    return f"""
with recursive d as (select row_number() over () as r, doc_id, source, lang, n_chars, text,
    case when doc_id is null or {crc32_sql("doc_id::varchar")} % 2 = 1 then text else replace(text, chr(10), '') end as cut
  from documents),
fields as (select r, doc_id, source,
    concat(coalesce(concat(strlen(doc_id::varchar), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
      coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::varchar), ':', n_chars), '-')) as head,
    coalesce(concat(strlen(text), ':', text), '-') as text, coalesce(concat(strlen(cut), ':', cut), '-') as cut from d),
leaves as (select r, doc_id, source, sha256(head || text) as leaf, sha256(head || cut) as other from fields),
placed as (select *, dense_rank() over (order by source nulls first) - 1 as s,
    row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 as p,
    count(*) over (partition by source) as m from leaves),
t as (select s, 0 as l, p, m, leaf as h from placed union all
    select s, l + 1, p // 3, (max(m) + 2) // 3, sha256(string_agg(h, '' order by p)) from t where m > 1
    group by s, l, p // 3),
u as (select -1::bigint as s, 0 as l, s as p, count(*) over () as m, h from t where m = 1 union all
    select s, l + 1, p // 3, (max(m) + 2) // 3, sha256(string_agg(h, '' order by p)) from u where m > 1
    group by s, l, p // 3),
runs as (select s, l, p // 3 as up, list(h order by p) as kids from (select * from t union all select * from u) where m > 1
    group by s, l, p // 3),
size as (select count(*) as trees from u where l = 0),
f as (select r, case when m = 1 then -1 else s end as s, 0 as l, case when m = 1 then s else p end as p,
      case when m = 1 then trees else m end as m, other as h, '' as proof from placed, size union all
    select r, case when top then -1 else f.s end, case when top then 0 else f.l + 1 end, case when top then f.s else f.p // 3 end,
      case when top then trees else (m + 2) // 3 end, sha256(left_ || h || right_), proof || left_ || right_
    from (select f.*, trees, (m + 2) // 3 = 1 and f.s >= 0 as top, array_to_string(kids[1:(f.p % 3)], '') as left_,
            array_to_string(kids[(f.p % 3) + 2:], '') as right_
          from f join runs on runs.s = f.s and runs.l = f.l and runs.up = f.p // 3, size where m > 1) as f),
done as (select r, h as folded_root, sha256(proof) as proof_sha256 from f where s = -1 and m = 1)
select doc_id, leaf, subs.h as subroot, root.h as root, proof_sha256, folded_root, folded_root = root.h as verified
from placed join done using (r) join (select s, h from t where m = 1) as subs on subs.s = placed.s,
  (select h from u where m = 1) as root
"""


def trie_sql() -> str:
    return f"""
with t as (select conv_id, turn, length(coalesce(text, '')) as tokens,
    sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as turn_key
  from conversations where conv_id is not null),
own as (select conv_id, list(turn_key order by turn nulls first, turn_key) as ks,
    list(tokens order by turn nulls first, turn_key) as ns,
    {crc32_sql("any_value(conv_id)::varchar")} % 6 as h from t group by conv_id),
whole as (select o.conv_id, coalesce(b.ks[1:o.h], []) || o.ks[(o.h + 1):] as ks,
    coalesce(b.ns[1:o.h], []) || o.ns[(o.h + 1):] as ns
  from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
p as (select conv_id, d, md5(array_to_string(ks[1:d], '')) as node, coalesce(ns[d], 0) as tokens,
    len(ks) = d as ends from (select *, unnest(range(0, len(ks) + 1)) as d from whole)),
nodes as (select d, node, count(*) as n, min(conv_id) as c, any_value(tokens) as tokens,
    sha256(coalesce(string_agg(case when ends then conv_id end, ',' order by conv_id), '')) as ends
  from p group by d, node),
up as (select n.*, o.node as parent, q.c as parent_c from nodes n
  left join p o on o.conv_id = n.c and o.d = n.d - 1
  left join nodes q on q.d = o.d and q.node = o.node),
kids as (select d - 1 as d, parent as node, count(*) as k from up where d > 0 group by 1, 2),
sub as (select a.d, a.node, sum((n.n - 1) * n.tokens)::bigint as saved,
    count(*) filter (where k.k is null) as leaves
  from nodes n left join kids k on k.d = n.d and k.node = n.node
  join p a on a.conv_id = n.c and a.d <= n.d group by a.d, a.node)
select c as conv_id, d as depth, parent_c as parent_conv_id, n as n_convs,
  coalesce(k, 0) as n_children, leaves as n_leaves, saved as saved_tokens, ends as ends_sha256
from up left join kids using (d, node) join sub using (d, node)
"""


def suffix_sql() -> str:
    return """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
p as (select r, unnest(range(0, len(x) // 2 - 399)) as p, x from d where len(x) >= 800),
w as (select r, p, md5_number(substr(x, 2 * p + 1, 800)) as h from p),
g as (select r, p, p + 400 as e, lag(p + 400) over (partition by r order by p) as before
  from (select *, count(*) over (partition by h) as n from w) where n > 1),
s as (select r, p, e, sum((before is null or before < p)::int) over (partition by r order by p) as span
  from g),
spans as (select r, span, min(p) as lo, max(e) as hi from s group by r, span),
kept as (select r, span, hi as lo, lead(lo) over (partition by r order by span) as hi from spans
  union all select r, 0, 0, min(lo) from spans group by r),
rest as (select d.r, string_agg(substr(x, 2 * lo + 1, 2 * (coalesce(hi, len(x) // 2) - lo)), ''
    order by span) as x from kept join d using (r) group by d.r),
removed as (select r, sum(hi - lo)::bigint as n_removed, count(*) as n_spans from spans group by r)
select doc_id, len(d.x) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
  coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest.x, d.x))) as kept_sha256
from d left join rest using (r) left join removed using (r)
"""
