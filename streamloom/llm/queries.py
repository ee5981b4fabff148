"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat_format import op1_chat_format
from .collocations import op11_collocations
from .decontaminate import op3_decontamination
from .jaccard_join import op12_jaccard_join
from .lang_id import op9_language_id
from .line_dedup import op5_line_dedup
from .lm_score import op8_lm_score
from .mixing import op7_mixing
from .multiset_hash import op4_fingerprints
from .resample import op13_resample
from .simhash_dedup import op10_simhash_dedup
from .url_filter import op2_url_filter
from .warc import op6_warc

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_fingerprints": op4_fingerprints,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_lm_score": op8_lm_score,
    "op9_language_id": op9_language_id,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_collocations": op11_collocations,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_resample": op13_resample,
}

#: The archives' result follows from the pages; base32 is spelled out from the bits of the digest.
OP6_SQL = """with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, min(page_id) over (partition by html) as first, array_to_string(list_transform(range(1, 41),
  lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
  [strpos('0123456789abcdef', substr(sha1(html), i, 1))]), '') as bits from p)
select page_id, cast(n as bigint) as payload_bytes, array_to_string(list_transform(range(0, 32), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(bits[5*j+1] as int) + 8 * cast(bits[5*j+2] as int)
  + 4 * cast(bits[5*j+3] as int) + 2 * cast(bits[5*j+4] as int) + cast(bits[5*j+5] as int), 1)), '') as payload_digest,
  case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first then first end as refers_to from d"""

#: crc32 is spelled out from its polynomial, the rest is the contract's.
OP13_SQL = r"""with steps as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
d as (select row_number() over () as k, doc_id, 0 as side, text from documents union all select row_number() over (), null, 1, text from benchmark),
w as (select k, doc_id, side, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from d),
g as (select k, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) as f from w),
u as (select f, row_number() over () as u from (select distinct f from g)),
b as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: cast(('0x' || substr(hex(encode(f)), 2*i-1, 2)) as bigint))), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) % 10000 as b from u, steps),
c as (select b, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from g join b using (f) group by b),
z as (select sum(s) as s, sum(t) as t from c),
n as (select b, cast(floor(1000 * ln((c.t + 1) * (z.s + 10000) / cast((c.s + 1) * (z.t + 10000) as double))) as bigint) as gain from c, z),
h as (select k, count(*) as nf, sum(gain) as sw from g join b using (f) join n using (b) where side = 0 group by k),
e as (select k, doc_id, len(w) as nw, coalesce(nf, 0) as nf, coalesce(sw, 0) as weight, cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from w left join h using (k) where side = 0),
r as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) as score from e),
q as (select *, row_number() over (order by nw >= 20 desc, score desc, doc_id nulls last, k) as p, (5 * (count(*) filter (nw >= 20) over ())) // 100 as m from r)
select doc_id, cast(nf as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, case when p <= m then p end as rank from q"""

OP11_SQL = r"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (select lang, 1 as k, unnest(w) as g from w
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) from w
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) from w),
f as (select lang, k, g, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select *, split_part(g, ' ', 1) as w1, split_part(g, ' ', 2) as w2, split_part(g, ' ', 3) as w3 from f where k >= 2 and f >= 10),
x as (select lang, k, g, f, 1 as cut, w1 as u, case k when 2 then w2 else w2 || ' ' || w3 end as v from c
  union all select lang, k, g, f, 2, w1 || ' ' || w2, w3 from c where k = 3),
s as (select x.*, l.f as l, r.f as r, (1000000::hugeint * x.f * x.f) // (l.f::hugeint * r.f) as score
  from x join f l on l.lang = x.lang and l.g = u join f r on r.lang = x.lang and r.g = v),
b as (select *, row_number() over (partition by lang, g order by score, cut) as nth from s),
m as (select lang, g, max(f) as m from (select lang, w1 || ' ' || w2 as g, f from c where k = 3 union all select lang, w2 || ' ' || w3, f from c where k = 3) group by all),
r as (select b.*, row_number() over (partition by b.lang order by score desc, f desc, b.g) as rank
  from b left join m on m.lang = b.lang and m.g = b.g where nth = 1 and (m is null or 100 * m < 50 * f))
select r.lang, rank, g as phrase, f as a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from r join n on n.lang = r.lang where rank <= 2000"""

#: All pairs that share a shingle, then everything that links reach.
OP12_SQL = r"""with recursive d as (select row_number() over () as k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select k, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from d),
h as (select k, len(s) as n, unnest(s) as h from s),
t as (select h, row_number() over () as i from h group by h having count(*) > 1),
i as (select k, n, i from h join t on t.h = h.h),
j as (select a.k as a, b.k as b from i a join i b on a.i = b.i and a.k < b.k and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.k, b.k, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l as (select a, b from j union all select b, a from j),
r as (select k, k as c from s union select r.k, l.b from r join l on l.a = r.c)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(o.doc_id) as component_id from s join r on r.k = s.k join s o on o.k = r.c group by s.k, s.doc_id, len(s.s)"""

ORACLE_SQL: dict[str, str] = {"op6_warc": OP6_SQL, "op11_collocations": OP11_SQL, "op12_jaccard_join": OP12_SQL, "op13_resample": OP13_SQL}
