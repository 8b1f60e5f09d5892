"""SQL (DuckDB) for queries of this subpackage that SQL can express, and queries of their parts that it can.

Whole tables take part; the SQL for operator 9 compares all pairs that share a shingle and the one for
operator 3 works on all prefix sums, so they are for small folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op7_secrets import op7_randomness_secrets
from .op8_quality import judge
from .op13_winnowing import BASE, JOIN, K, LARGE, PRIME, WINDOW

_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '{_WORD}') w from documents),
s as materialized (select distinct doc_id, sh from (select doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end sh from w, unnest(range(1, greatest(len(w), 2))) t(i) where len(w) > 0)),
n as materialized (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e2 as materialized (select a, b from e union select b, a from e), r(a, b) as (select a, b from e2 union select r.a, e2.b from r join e2 on e2.a = r.b),
c as (select d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) component_id from documents d left join r on r.a = d.doc_id group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id = component_id kept from c left join n using (doc_id)"""

# a byte's step of the checksum, eight times over; binary search and greedy walk as one recursion
OP3 = """
with recursive f(i, k, c) as (select i, 0, i from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from f where k < 8),
tab as materialized (select list(c order by i) tab from f where k = 8),
d as materialized (select doc_id, coalesce(text, '') t, strlen(coalesce(text, '')) + 1 size from documents),
b as (select doc_id, list_transform(regexp_extract_all(hex(t), '..'), lambda x: ((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)::bigint) b from d),
crc as materialized (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) crc from b, tab),
g as (select t, min(doc_id) first, sum(size) bytes from d group by 1), c as materialized (select t, bytes, sum(bytes) over (order by first)::bigint cum from g),
k as materialized (select max(cum) tot, max(bytes)::bigint big from c),
s(lo, hi, mid, pos, used) as (select greatest(big, (tot + 15) // 16), tot, (greatest(big, (tot + 15) // 16) + tot) // 2, 0::bigint, 0 from k union all
 select case when pos < tot and used = 16 then mid + 1 else lo end, case when pos = tot then mid else hi end, case when pos = tot then (lo + mid) // 2 when used = 16 then (mid + 1 + hi) // 2 else mid end,
 case when pos = tot or used = 16 then 0 else (select max(cum) from c where cum <= s.pos + s.mid) end, case when pos = tot or used = 16 then 0 else used + 1 end from s, k where lo < hi),
cap as materialized (select min(hi) cap from s), w(pos, n) as (select 0::bigint, 0 union all select (select max(cum) from c, cap where cum <= w.pos + cap.cap), n + 1 from w, k where pos < tot),
h as (select t, (select count(*) from w where n > 0 and pos < cum) shard from c)
select d.doc_id, size::bigint size, crc::bigint text_crc32, 'bytes' law, shard::int shard, (row_number() over (partition by shard order by d.doc_id) - 1)::bigint slot, null::int grown_shard from d join h using (t) join crc using (doc_id)"""

# shares of all kept terms, also of those that a group lacks
OP11 = """
with d as materialized (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+') w from documents),
t as materialized (select r, lang, source, unnest(w) term from d),
k as materialized (select lang, term, count(*)::hugeint ln from t group by 1, 2 having count(distinct r) >= 10),
l as materialized (select lang, count(*)::hugeint v, sum(ln)::hugeint n from k group by 1),
c as materialized (select t.lang, source, term, count(*)::hugeint n from t join k using (lang, term) group by 1, 2, 3),
g as materialized (select x.lang, x.source, coalesce(l.v, 0) v, coalesce(l.n, 0) ln, coalesce(s.n, 0) n from (select distinct lang, source from d) x left join l using (lang) left join (select lang, source, sum(n)::hugeint n from c group by 1, 2) s using (lang, source)),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) p, 1 + (1000000000 * (k.ln + 2)) // (g.ln + 2 * g.v) q from g join k using (lang) left join c using (lang, source, term)),
y as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
o as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0) value, 1000000000 top from g a join g b on a.lang = b.lang and a.source <> b.source left join y on y.lang = a.lang and y.source = a.source and y.item = b.source
 union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q), 10 from p where n > 0 and p > q)
select lang, source, part, item, value::bigint value, (row_number() over w)::int rank from o window w as (partition by lang, source, part order by value desc, item) qualify row_number() over w <= top"""

# a run of 24 words or more and three periods matches itself a period on for 16 words or more, so equal 16-grams give all
OP12 = f"""
with recursive f(i, k, c) as (select i, 0, i from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from f where k < 8), tab as materialized (select list(c order by i) tab from f where k = 8),
d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda z: unicode(z)::bigint)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) h from documents, tab),
e as (select doc_id, w, len(w) n, h % 10 = 0 and len(w) > 0 again, case when len(w) > 0 then (h // 10) % len(w) end a, 3 + (h // 10) % 8 parts from d), t as (select *, 1 + (n - a) // parts p from e),
w as materialized (select doc_id, i, case when again and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end x from t, unnest(range(n)) u(i)), l as (select doc_id, list(x order by i) l from w group by 1),
g as materialized (select doc_id, i, array_to_string(l[i + 1:i + 16], ' ') g from l, unnest(range(len(l) - 15)) u(i)), m as (select a.doc_id, b.i - a.i p, a.i from g a join g b on a.doc_id = b.doc_id and a.g = b.g and a.i < b.i),
o as (select doc_id, p, i, i - row_number() over (partition by doc_id, p order by i) k from m), r as (select doc_id, p, min(i) s, max(i) - min(i) + 16 + p n from o group by doc_id, p, k), c as materialized (select * from r where n >= greatest(24, 3 * p)),
z as materialized (select * from c where not exists (select 1 from c q where q.doc_id = c.doc_id and q.p < c.p and q.s <= c.s and q.s + q.n >= c.s + c.n)),
y as (select doc_id, count(*) k, string_agg(s || ',' || n || ',' || p || chr(10), '' order by s, p) v from z group by 1), b as (select * from z qualify row_number() over (partition by doc_id order by n::double / p desc, s, p) = 1), x as (select distinct doc_id, unnest(range(s + p, s + n)) i from z),
j as (select w.doc_id, string_agg(x, ' ' order by w.i) v from w left join x using (doc_id, i) where x.doc_id is null group by 1)
select d.doc_id, coalesce(k, 0)::bigint n_runs, s::bigint "start", n::bigint length, p::bigint period, (1000 * n // p)::bigint exponent_milli, sha256(coalesce(y.v, '')) runs_sha256, sha256(coalesce(j.v, '')) collapsed_sha256 from d left join y using (doc_id) left join b using (doc_id) left join j using (doc_id)"""

# a row for each code point of each text and edited text; hashes of 2, 4, 8 and 16 code points, the least of 49
_TIMES = [pow(BASE, n, PRIME) for n in (1, 2, 4)]
OP13 = f"""
with d as (select doc_id, coalesce(text, '') t, coalesce(lead(coalesce(text, '')) over w, first_value(coalesce(text, '')) over w) nx, coalesce(lead(doc_id) over w, first_value(doc_id) over w) nid from documents window w as (order by doc_id desc)),
e as materialized (select doc_id, nid, t, length(t)::bigint n, left(t, length(t) - length(t) // 2) || left(nx, length(t) // 2) ed from d), x as (select doc_id, 0 v, t s from e union all select doc_id, 1, ed from e),
c as (select doc_id, v, unnest(range(len(l))) i, unnest(list_transform(l, lambda z: unicode(z)::bigint)) c from (select doc_id, v, string_split(s, '') l from x where s <> '') union all select doc_id, v, -j, 0 from (select doc_id, v, length(s) n from x where s <> ''), range(1, {K}) u(j) where j <= {K} - n),
h2 as (select *, (c * {_TIMES[0]} + lead(c, 1) over w) % {PRIME} h from c window w as (partition by doc_id, v order by i)), h4 as (select doc_id, v, i, (h * {_TIMES[1]} + lead(h, 2) over w) % {PRIME} h from h2 window w as (partition by doc_id, v order by i)),
h8 as (select doc_id, v, i, (h * {_TIMES[2]} + lead(h, 4) over w) % {PRIME} h from h4 window w as (partition by doc_id, v order by i)), g as (select doc_id, v, greatest(i, 0) p, (h * {JOIN} + lead(h, 8) over w) % {LARGE} h from h8 window w as (partition by doc_id, v order by i)),
m as (select doc_id, v, row_number() over w r, count(*) over (partition by doc_id, v) n, min(h::hugeint * 4294967296 + (4294967295 - p)) over (w rows between current row and {WINDOW - 1} following) m from g where h is not null window w as (partition by doc_id, v order by p)),
f as materialized (select distinct doc_id, v, (m // 4294967296)::bigint h, (4294967295 - m % 4294967296)::bigint p from m where r <= greatest(1, n - {WINDOW - 1})), s as materialized (select distinct doc_id, v, h from f), k as (select doc_id, v, count(*) n from s group by 1, 2),
w as (select doc_id, v, string_agg(lower(hex(h)) || ':' || p, ',' order by p) w from f group by 1, 2),
b as (select e.doc_id, 1 q, count(*) n from e join s a on a.doc_id = e.doc_id and a.v = 0 join s b on b.doc_id = e.doc_id and b.v = 1 and b.h = a.h group by 1 union all select e.doc_id, 0, count(*) from e join s a on a.doc_id = e.doc_id and a.v = 0 join s b on b.doc_id = e.nid and b.v = 0 and b.h = a.h group by 1),
z as (select e.*, coalesce(k0.n, 0) a, coalesce(k1.n, 0) b, coalesce(k2.n, 0) c, coalesce(b1.n, 0) ab, coalesce(b0.n, 0) ac from e left join k k0 on k0.doc_id = e.doc_id and k0.v = 0 left join k k1 on k1.doc_id = e.doc_id and k1.v = 1 left join k k2 on k2.doc_id = e.nid and k2.v = 0 left join b b1 on b1.doc_id = e.doc_id and b1.q = 1 left join b b0 on b0.doc_id = e.doc_id and b0.q = 0)
select z.doc_id, n n_chars, sha256(ed) edited_sha256, coalesce(w0.w, '') fingerprint, coalesce(w1.w, '') edited_fingerprint, case when a + b = 0 then 1.0 else ab / (a + b - ab) end::double near_edited, case when a + c = 0 then 1.0 else ac / (a + c - ac) end::double near_next
from z left join w w0 on w0.doc_id = z.doc_id and w0.v = 0 left join w w1 on w1.doc_id = z.doc_id and w1.v = 1"""

QUALITY = f"""
with d as (select doc_id, coalesce(text, '') t from documents), w as materialized (select doc_id, t, regexp_extract_all(t, '{_WORD}') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) l from d),
g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') g from w, unnest(range(1, len(w) - 3)) t(i)), r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) c from g) where c > 1), m as (select doc_id, count(distinct i + j) n from r, range(5) t(j) group by 1)
select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
 coalesce(n, 0)::bigint n_repeat_words, len(w) < 10 or 100 * coalesce(n, 0) > 20 * len(w) base_failed from w left join m using (doc_id)"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = f"""
select doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2), lambda x: length(x) >= 6))::bigint n_assign, len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint n_access,
 len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint n_hex from documents"""


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 without the line field: its counts and the base rules."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), None).drop("kept", "content_share")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7's spans of the patterns, counted."""
    return op7_randomness_secrets(spark, sf_dir).select("doc_id", F.col("n_assign"), F.col("n_access"), F.col("n_hex"))


ORACLES = {"op3_minimax_shards": OP3, "op9_circulant_minhash": OP9, "op11_source_divergence": OP11, "op12_periodic_runs": OP12, "op13_winnowing": OP13, "quality_base_counts": QUALITY, "secret_base_counts": SECRETS}
