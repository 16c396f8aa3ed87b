"""SQL of the queries that SQL can express, for an independent engine on the same tables."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Five hex digits are twenty bits, and so four letters of base 32.
WARC = """with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, html, sha1(html) h, max(page_id) over (partition by html) keeper from p)
select page_id, cast(octet_length(encode(html)) as bigint) payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, 5 * g + 1, 5) as bigint) >> (15 - 5 * k)) & 31), 1) for k in range(0, 4)], '') for g in range(0, 8)], '') payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end record_type, case when page_id <> keeper then keeper end refers_to from d"""

NGRAM = f"""with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+'), []) w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) end s from w),
c as (select s, min(doc_id) rep, len(s) n from s where len(s) > 0 group by s),
t as (select rep, n, unnest(s) g from c),
met as (select a.rep u, b.rep v, any_value(a.n) nu, any_value(b.n) nv, count(*) k from t a join t b on a.g = b.g and a.rep < b.rep group by a.rep, b.rep),
link as (select u, v from met where 100 * k >= 90 * (nu + nv - k)),
e as (select u, v from link union select v, u from link),
r as (select rep node, rep root from c union select r.node, e.v from r join e on e.u = r.root),
m as (select node, min(root) component_id from r group by node)
select s.doc_id, cast(len(s.s) as bigint) n_shingles, coalesce(m.component_id, s.doc_id) component_id from s left join c on s.s = c.s left join m on m.node = c.rep"""

ORACLE = {"op7_seekable_warc": WARC, "op10_ngram_jaccard": NGRAM}
