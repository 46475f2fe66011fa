"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from symlattice.llm.line_dedup import MIN_LENGTH, THRESHOLD
from symlattice.llm.quality import FENCES, MIN_GROUP

_SPACE = r"[\x20\x09-\x0D]+"

#: Each byte's 100-byte string is compared by its hash; a byte goes if one of the 100 strings over it starts earlier elsewhere.
OP4 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
q as (select doc_id, h, len(h) // 2 as n, unnest(range(0, (len(h) // 2 + 999) // 1000)) as k from d),
p as (select doc_id, k, n, substr(h, 2000 * k + 1, 2200) as h from q),
j as (select *, unnest(range(0, least(1000, n - 1000 * k))) as j from p),
b as (select doc_id, 1000 * k + j as i, n, substr(h, 2 * j + 1, 2) as x, hash(substr(h, 2 * j + 1, 200)) as s from j),
f as (select s, min(doc_id * 100000000 + i) as first from b where i + 100 <= n group by s),
g as (select b.doc_id, b.i from b join f on f.s = b.s where i + 100 <= n and b.doc_id * 100000000 + b.i > f.first),
c as (select b.doc_id, b.i, b.x, max(g.i) over (partition by b.doc_id order by b.i rows between 99 preceding and current row) is not null as gone from b left join g on g.doc_id = b.doc_id and g.i = b.i),
e as (select *, lag(gone, 1, false) over (partition by doc_id order by i) as before from c),
r as (select doc_id, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where gone and not before) as n_spans, coalesce(string_agg(case when not gone then x end, '' order by i), '') as kept from e group by doc_id)
select d.doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join r on r.doc_id = d.doc_id
"""

OP7 = rf"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from p join n u on u.doc_id = x join n v on v.doc_id = y where 100 * c >= 75 * (u.n + v.n - c)),
e as (select x, y from l union select y, x from l),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on e.x = r.y),
m as (select x, min(y) as y from r group by x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(m.y, d.doc_id)) as kept from d left join n on n.doc_id = d.doc_id left join m on m.x = d.doc_id
"""

OP10 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from k where rank <= 5
"""

#: The sketches hold every value of a group of up to SKETCH_K rows, so there their quantiles are exact; larger groups are beyond SQL.
_RATIOS = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "stutter_ratio": ("n_stutters", "n_words"), "word_length": ("word_chars", "n_words")}


def _op1() -> str:
    ratios = ", ".join(f"case when {b} > 0 then {a}::double / {b}::double else 0.0 end as {c}" for c, (a, b) in _RATIOS.items())
    # the value at rank ceil(q n), of the document's own group, else its language, else all
    pick = lambda c, q: f"case when g.n >= {MIN_GROUP} then g.{c}[ceil({q}::double * g.n)::int] when l.n >= {MIN_GROUP} then l.{c}[ceil({q}::double * l.n)::int] else e.{c}[ceil({q}::double * e.n)::int] end"
    lists = ", ".join(f"list({c} order by {c}) as {c}" for c in FENCES)
    tops = ", ".join(f"{pick(c, FENCES[c][0])} as top_{c}, {pick(c, 0.5)} as mid_{c}" for c in FENCES)
    passes = " and ".join(f"{c} <= top_{c} + {factor}::double * (top_{c} - mid_{c}) + {margin}::double" for c, (_, factor, margin) in FENCES.items())
    return rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as c from (select doc_id, i, array_to_string(w[i:i + 7], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d))) where c > 1),
c as (select doc_id, count(distinct i + k) as n_repeat_words from r, unnest(range(0, 8)) t(k) group by doc_id),
m as (select d.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  len(lines) as n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutters from d left join c on c.doc_id = d.doc_id),
x as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {ratios} from m),
g as (select lang, source, count(*) as n, {lists} from x where not base_failed group by lang, source),
l as (select lang, count(*) as n, {lists} from x where not base_failed group by lang),
e as (select count(*) as n, {lists} from x where not base_failed),
t as (select x.*, {tops} from x left join g on g.lang is not distinct from x.lang and g.source is not distinct from x.source left join l on l.lang is not distinct from x.lang cross join e)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({passes}, false) as kept from t
"""


#: Letters of the documents beyond ASCII, which the distance here, made for bytes, sees as one each.
_LETTERS = "éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍ"
_ONE_BYTE = " || ".join(f"chr({n})" for n in [*range(1, 9), *range(14, 14 + len(_LETTERS) - 8)])

#: Every segment of a line is looked for at each shift of up to two places in lines of up to two characters more.
OP8 = f"""
with d as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null),
l as (select doc_id, i as pos, l[i] as line from d, unnest(range(1, len(l) + 1)) t(i)),
u as (select line, length(line) as n, min(doc_id * 1000000 + pos) as first, translate(line, '{_LETTERS}', {_ONE_BYTE}) as plain from l where length(line) >= {MIN_LENGTH} group by line),
s as (select line, plain, first, n, i, substr(line, (i - 1) * n // 3 + 1, i * n // 3 - (i - 1) * n // 3) as part from u, unnest([1, 2, 3]) t(i)),
p as (select line, plain, first, n - d as n, i, substr(line, (i - 1) * (n - d) // 3 + 1 + b, i * (n - d) // 3 - (i - 1) * (n - d) // 3) as part from u, unnest([0, 1, 2]) x(d), unnest([1, 2, 3]) y(i), unnest([-2, -1, 0, 1, 2]) z(b) where (i - 1) * (n - d) // 3 + 1 + b >= 1),
k as (select distinct p.line as a, p.plain as x, p.first as fa, s.line as b, s.plain as y, s.first as fb from p join s on s.i = p.i and s.n = p.n and s.part = p.part and s.line <> p.line),
near as (select distinct case when fa > fb then a else b end as line from k where levenshtein(x, y) <= {THRESHOLD}),
g as (select l.*, coalesce(doc_id * 1000000 + pos > u.first, false) as exact, near.line is not null as close from l left join u on u.line = l.line left join near on near.line = l.line),
r as (select doc_id, count(*) as n_lines, count(*) filter (where exact) as n_exact_removed, count(*) filter (where close and not exact) as n_near_removed, coalesce(string_agg(line, chr(10) order by pos) filter (where not exact and not close), '') as kept from g group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_exact_removed, 0) as n_exact_removed, coalesce(n_near_removed, 0) as n_near_removed, length(kept) as kept_chars, sha256(kept) as kept_sha256 from documents d left join r on r.doc_id = d.doc_id
"""

ORACLE = {"op1_quality_rules": _op1(), "op4_substring_dedup": OP4, "op7_near_dedup": OP7, "op8_line_dedup": OP8, "op10_exact_topk": OP10}
