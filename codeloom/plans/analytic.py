"""Graph, vector, text, classification and streaming operators, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import exprs as E
from codeloom.literals import literal_rows
from codeloom.operators import classify as K
from codeloom.operators import graph as G
from codeloom.operators import lookup as L
from codeloom.operators import vectors as V
from codeloom.plans.registry import Tables, query
from codeloom.plans.relational import EDGES, supplier_edges
from codeloom.streaming import feeds as S

_NODES = "nodes as materialized (select src node from edges union select dst from edges)"


@query(f"""with {EDGES}, d as (select node, sum(i) i, sum(o) o from (select dst node, 1 i, 0 o from edges union all select src, 0, 1 from edges) group by 1)
select node, i::bigint ca, o::bigint ce, round(o / (i + o), 6) instability from d""")
def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees and instability."""
    return G.coupling(supplier_edges(Tables(spark, sf_dir))).withColumn("instability", F.round("instability", 6))


#: Rounds that the SQL of iterations unrolls; it fails where they have not come to rest by then.
_UNROLLED = 14


def _rests(k: int, columns: list[str], tolerance: float) -> list[str]:
    """SQL for one round's end: ``x{k}`` becomes ``r{k + 1}`` unless the rounds have come to rest before."""
    kept = ", ".join(f"case when s then r.{c} else x.{c} end {c}" for c in columns)
    small = " and ".join(f"(select coalesce(sum(abs(x.{c} - r.{c})), 0) from x{k} x join r{k} r using (node)) < {tolerance}" for c in columns)
    return [f"r{k + 1} as materialized (select node, {kept} from x{k} x join r{k} r using (node), s{k})", f"s{k + 1} as materialized (select s or ({small}) s from s{k})"]


def _at_rest(columns: list[str]) -> str:
    return ", ".join(f"round(case when s then {c} else error('not at rest') end, 6) \"{c}\"" for c in columns) + f" from r{_UNROLLED}, s{_UNROLLED}"


def _pagerank_sql() -> str:
    out = [f"with {EDGES}, {_NODES}, n as (select count(*)::double n from nodes), deg as (select src, count(*)::double o from edges group by 1), r0 as materialized (select node, 1 / n \"value\" from nodes, n), s0 as (select false s)"]
    for k in range(_UNROLLED):
        out.append(f"""l{k} as (select coalesce(sum("value"), 0) l from r{k} left join deg on src = node where o is null), g{k} as (select e.dst node, sum("value" / o) g from edges e join r{k} on r{k}.node = e.src join deg d on d.src = e.src group by 1),
x{k} as materialized (select x.node, 0.15 / n + 0.85 * l / n + 0.85 * coalesce(g, 0) "value" from nodes x left join g{k} using (node), n, l{k})""")
        out += _rests(k, ["value"], 1e-6)
    return ", ".join(out) + f" select node, {_at_rest(['value'])}"


@query(_pagerank_sql())
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank to a change below 1e-6, in 50 rounds at most."""
    return G.pagerank(supplier_edges(Tables(spark, sf_dir))).withColumn("value", F.round("value", 6))


def _hits_sql() -> str:
    out = [f"with {EDGES}, {_NODES}, r0 as materialized (select node, 1.0::double authority, 1.0::double hub from nodes), s0 as (select false s)"]
    for k in range(_UNROLLED):
        for new, old, to, frm in ((f"a{k}", f"(select node, hub v from r{k})", "dst", "src"), (f"h{k}", f"a{k}", "src", "dst")):
            out.append(f"""t_{new} as materialized (select x.node, coalesce(s, 0)::double v from nodes x left join (select e.{to} node, sum(v) s from edges e join {old} o on o.node = e.{frm} group by 1) using (node)),
{new} as materialized (select node, v / (case when s > 0 then s else 1 end) v from t_{new}, (select sqrt(sum(v * v)) s from t_{new}))""")
        out.append(f"x{k} as materialized (select node, a.v authority, h.v hub from a{k} a join h{k} h using (node))")
        out += _rests(k, ["authority", "hub"], 1e-8)
    return ", ".join(out) + f" select node, {_at_rest(['authority', 'hub'])}"


@query(_hits_sql())
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs and authorities to a change below 1e-8, in 50 rounds at most."""
    x = G.hits(supplier_edges(Tables(spark, sf_dir)))
    return x.select("node", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


def _eigen_sql() -> str:
    out = [f"with {EDGES}, {_NODES}, r0 as materialized (select node, 1 / sqrt((select count(*) from nodes)) \"value\" from nodes), s0 as (select false s)"]
    for k in range(_UNROLLED):
        out.append(f"""t{k} as materialized (select x.node, coalesce(s, 0)::double v from nodes x left join (select e.dst node, sum("value") s from edges e join r{k} o on o.node = e.src group by 1) using (node)),
x{k} as materialized (select node, v / s "value" from t{k}, (select sqrt(sum(v * v)) s from t{k}))""")
        out += _rests(k, ["value"], 1e-8)
    return ", ".join(out) + f" select node, {_at_rest(['value'])}"


@query(_eigen_sql())
def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvector centrality to a change below 1e-8, in 50 rounds at most."""
    return G.eigenvector(supplier_edges(Tables(spark, sf_dir))).withColumn("value", F.round("value", 6))


def _betweenness_sql(depth: int) -> str:
    """Levels of shortest paths from every node, then pairs whose shortest path leads through a node."""
    out = [f"with {EDGES}, {_NODES}, f0 as materialized (select node s, node v, 1.0::double p from nodes)", "k0 as materialized (select s, v, p, 0 d from f0)"]
    for k in range(1, depth + 1):
        out.append(f"""f{k} as materialized (select f.s, e.dst v, sum(f.p) p from f{k - 1} f join edges e on e.src = f.v where not exists (select 1 from k{k - 1} k where k.s = f.s and k.v = e.dst) group by 1, 2),
k{k} as materialized (select * from k{k - 1} union all select s, v, p, {k} from f{k})""")
    return ", ".join(out) + f""", x as (select a.v node, sum(a.p * b.p / c.p) b from k{depth} a join k{depth} b on b.s = a.v join k{depth} c on c.s = a.s and c.v = b.v and c.d = a.d + b.d where a.s <> a.v and b.v <> a.v and a.s <> b.v group by 1)
select n.node, round(case when (select count(*) from nodes) < 3 then 0 else coalesce(b, 0) / (((select count(*) from nodes) - 1) * ((select count(*) from nodes) - 2)) end, 6) as \"value\" from nodes n left join x using (node)"""


@query(_betweenness_sql(12))
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of shortest paths."""
    return G.betweenness(supplier_edges(Tables(spark, sf_dir))).withColumn("value", F.round("value", 6))


_CLOSURE = """r(a, b) as (select src, dst from e2 union select r.a, e.dst from r join e2 e on e.src = r.b)"""


@query(f"""with recursive {EDGES}, {_NODES}, e2 as materialized (select src, dst from edges union select dst, src from edges), {_CLOSURE}
select node, least(node, coalesce(min(b), node)) component from nodes left join r on a = node group by node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components, isolated nodes included."""
    e = supplier_edges(Tables(spark, sf_dir))
    return G.components(e, G.nodes_of(e))


@query(f"""with recursive {EDGES}, m as (select s_suppkey node, s_nationkey grp from supplier), g as (select src, dst from edges join m a on a.node = src join m b on b.node = dst where a.grp = b.grp),
e2 as materialized (select src, dst from g union select dst, src from g), {_CLOSURE}, c as (select node, grp, least(node, coalesce(min(b), node)) comp from m left join r on a = node group by 1, 2)
select grp, count(distinct comp)::bigint lcom4 from c group by 1""")
def lcom4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components inside each group."""
    t = Tables(spark, sf_dir)
    return G.lcom4(supplier_edges(t), t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("grp")))


@query(f"""with recursive {EDGES}, e2 as materialized (select src, dst from edges), {_CLOSURE}, s as (select x.a node, min(x.b) low, count(distinct x.b) n from r x join r y on y.a = x.b and y.b = x.a group by 1), k as (select low, n, row_number() over (order by n desc, low) scc from (select distinct low, n from s))
select node, scc::int scc, s.n::bigint scc_size from s join k using (low) where s.n > 1""")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8, SK11: strongly connected components, numbered by size."""
    return G.strong_components(supplier_edges(Tables(spark, sf_dir)))


@query(f"""with recursive {EDGES}, w(node, depth) as (select 3::bigint, 0 union select e.src, depth + 1 from w join edges e on e.dst = w.node where depth < 3)
select node, min(depth)::int depth from w group by 1 having min(depth) > 0""")
def bfs_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers upward to a depth, the first depth of each."""
    return G.walk_callers(supplier_edges(Tables(spark, sf_dir)), literal_rows(spark, [(3,)], "node long"), 3)


@query(f"""with recursive {EDGES}, b as materialized (select src, dst from (select *, row_number() over (partition by src order by dst) n from edges) where n <= 2),
w(node, depth) as (select 3::bigint, 0 union select b.dst, depth + 1 from w join b on b.src = w.node where depth < 3), f as (select node, min(depth) d from w group by 1)
select b.src, b.dst, (d + 1)::int depth from f join b on b.src = f.node where d < 3""")
def bfs_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees downward with a fan-out cap, edges kept."""
    return G.walk_callees(supplier_edges(Tables(spark, sf_dir)), literal_rows(spark, [(3,)], "node long"), 3, 2)


@query(f"""with recursive {EDGES}, d as (select src, dst from edges join supplier a on a.s_suppkey = src join supplier b on b.s_suppkey = dst where a.s_nationkey < b.s_nationkey), n as (select src node from d union select dst from d), w(node, level) as (select node, 0 from n where node not in (select dst from d) union select d.dst, level + 1 from w join d on d.src = w.node)
select node, max(level)::int level from w group by 1""")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topological levels of the edges from a nation to a later one, which have no cycle."""
    t = Tables(spark, sf_dir)
    nation = lambda c: t.supplier.select(F.col("s_suppkey").alias(c), F.col("s_nationkey").alias(f"n_{c}"))
    down = supplier_edges(t).join(nation("src"), "src").join(nation("dst"), "dst").filter("n_src < n_dst").select("src", "dst")
    return G.topological_levels(down)[0]


@query(f"""with {EDGES}, two as (select src a, dst b from edges where src < dst), c2 as (select [a, b] path from two join edges on src = b and dst = a), p3 as (select a, b, dst c from two join edges on src = b where dst > a and dst <> b),
c3 as (select [a, b, c] path from p3 join edges on src = c and dst = a) select array_to_string(p, '>') path from (select path p from c2 union all select path from c3) order by len(p), p limit 10""")
def cycle_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten cycles, the shortest first."""
    return G.cycles(supplier_edges(Tables(spark, sf_dir))).select(F.array_join("path", ">").alias("path"))


@query(f"""with {EDGES}, k as (select s_suppkey node from supplier where s_acctbal > 5000) select src, dst from edges where src in (select node from k) and dst in (select node from k)""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inside a set of nodes."""
    t = Tables(spark, sf_dir)
    return G.induced(supplier_edges(t), t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("node")))


@query(f"with {EDGES} select src, array_to_string(list(dst order by dst), ',') targets from edges group by 1")
def dependency_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted targets of each source."""
    return G.adjacency(supplier_edges(Tables(spark, sf_dir))).select("src", F.array_join("targets", ",").alias("targets"))


@query(f"""with recursive {EDGES}, sc as (select s_suppkey node, s_acctbal score from supplier where s_acctbal > 0), w(start, path, d) as (select v, [v], 0 from (values (1::bigint), (3), (7)) t(v) union all
 select start, list_append(path, (select e.dst from edges e join sc on sc.node = e.dst where e.src = path[-1] and not list_contains(path, e.dst) order by sc.score desc, e.dst limit 1)), d + 1 from w
 where d < 5 and exists (select 1 from edges e join sc on sc.node = e.dst where e.src = path[-1] and not list_contains(path, e.dst)))
select start, array_to_string(path, '>') path from w qualify row_number() over (partition by start order by d desc) = 1""")
def primary_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy path of best-scored callees."""
    t = Tables(spark, sf_dir)
    x = G.primary_flow(supplier_edges(t), literal_rows(spark, [(1,), (3,), (7,)], "node long"), t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("score")))
    return x.select("start", F.array_join("path", ">").alias("path"))


@query(f"""with {EDGES}, d as (select node, sum(i) i, sum(o) o from (select dst node, 1 i, 0 o from edges union all select src, 0, 1 from edges) group by 1), a as (select s_suppkey node, s_acctbal / 10000 ab from supplier where s_acctbal >= 0)
select a.node, round(ab, 6) abstractness, round(abs(ab + coalesce(o / (i + o), 0) - 1), 6) distance, abs(ab + coalesce(o / (i + o), 0) - 1) > 0.7 flagged from a left join d using (node)""")
def main_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from the main sequence."""
    from codeloom.operators.aggregates import distance

    t = Tables(spark, sf_dir)
    a = t.supplier.filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 10000).alias("abstractness"))
    x = distance(a.join(G.coupling(supplier_edges(t)).select("node", "instability"), "node", "left"))
    return x.select("node", F.round("abstractness", 6).alias("abstractness"), F.round("distance", 6).alias("distance"), "flagged")


# vectors and names


@query("""
with q as (select vec_id query_id, embedding::double[] q from embeddings where vec_id % 100 = 0), v as (select vec_id, embedding::double[] v from embeddings),
x as (select query_id, vec_id, list_cosine_similarity(q, v) s from q, v where vec_id <> query_id), r as (select *, row_number() over (partition by query_id order by s desc, vec_id) rank from x where s >= 0.1)
select query_id, vec_id, round(s, 4) similarity, rank::int rank from r where rank <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: the nearest vectors of the stated query set: every id divisible by 100, against all rows."""
    e = Tables(spark, sf_dir).embeddings.select("vec_id", "embedding")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return V.nearest(q, e, 10, 0.1).select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"), F.col("rank").cast("int").alias("rank"))


@query("""
with v as (select vec_id, label, embedding::double[] v from embeddings) select a.label, a.vec_id id_a, b.vec_id id_b, round(list_cosine_similarity(a.v, b.v), 4) similarity from v a join v b on a.label = b.label and a.vec_id < b.vec_id
where list_cosine_similarity(a.v, b.v) >= 0.3""")
def sim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs inside a group."""
    x = V.similar_pairs(Tables(spark, sf_dir).embeddings, "label", 0.3)
    return x.withColumn("similarity", F.round("similarity", 4))


@query("""
with n as (select distinct p_name from part), q(query) as (values ('red widgt'), ('smal rign'), ('hot rods'), ('blue bolt')),
x as (select query, p_name, levenshtein(lower(query), lower(p_name)) d, case when length(query) <= 3 then 1 when length(query) <= 6 then 2 when length(query) <= 12 then 3 else 4 end m from q, n),
r as (select *, row_number() over (partition by query order by d, length(p_name), p_name) rank from x where d > 0 and d <= m)
select query, p_name, d::int distance, rank::int rank from r where rank <= 5""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within an edit distance."""
    inputs = literal_rows(spark, [(n,) for n in ("red widgt", "smal rign", "hot rods", "blue bolt")], "query string")
    return L.fuzzy(inputs, Tables(spark, sf_dir).part.select("p_name"), "p_name").select("query", "p_name", F.col("distance").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))


@query("""
select distinct word, case when ends_with(word, 'ing') and length(word) > 6 then left(word, length(word) - 3) when ends_with(word, 'tion') and length(word) > 7 then left(word, length(word) - 4) when ends_with(word, 'ed') and length(word) > 5 then left(word, length(word) - 2)
 when ends_with(word, 'er') and length(word) > 5 then left(word, length(word) - 2) when ends_with(word, 'es') and length(word) > 5 then left(word, length(word) - 2) when ends_with(word, 's') and length(word) > 4 then left(word, length(word) - 1) else word end stem
from (select unnest(string_split(text, ' ')) word from benchmark) where regexp_matches(word, '^[a-z]+$')""")
def stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of words."""
    w = Tables(spark, sf_dir).benchmark.select(F.explode(F.split("text", " ")).alias("word")).filter(F.col("word").rlike("^[a-z]+$")).distinct()
    return w.select("word", E.stem(F.col("word")).alias("stem"))


# text


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from documents)
select doc_id, n::int line_no, (length(regexp_extract(line, '^(.*?)licensed', 1, 'i')) + 1)::int col_no, len(regexp_extract_all(line, '(?i)licensed'))::int n_matches from l where regexp_matches(line, '(?i)licensed')""")
def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13, C13: lines that match a pattern, with places and counts."""
    return L.text_hits(Tables(spark, sf_dir).documents.select("doc_id", "text"), "(?i)licensed", "doc_id", "text").drop("line")


@query("""
select doc_id, source, (case when contains(text, 'Licensed under') then 'const' else 'fixture' end) kind from documents where contains(text, 'Licensed under') or contains(text, 'All rights reserved') order by doc_id limit 50""")
def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a literal, classified, the first fifty."""
    d = Tables(spark, sf_dir).documents.filter(F.col("text").contains("Licensed under") | F.col("text").contains("All rights reserved"))
    return d.select("doc_id", "source", F.when(F.col("text").contains("Licensed under"), "const").otherwise("fixture").alias("kind")).orderBy("doc_id").limit(50)


_ZONE_SQL = ", ".join("case when " + " or ".join(f"contains(lower(text), '{w}')" for w in words) + f" then '{zone}' end" for zone, words in K.ZONES.items())


@query(f"""
with z as (select doc_id, list_sort(list_filter([{_ZONE_SQL}], lambda x: x is not null)) z from documents) select doc_id, array_to_string(z, ',') zones from z where len(z) > 0""")
def sensitive_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of texts by the built-in words."""
    x = Tables(spark, sf_dir).documents.select("doc_id", K.zones(F.col("text")).alias("z")).filter(F.size("z") > 0)
    return x.select("doc_id", F.array_join("z", ",").alias("zones"))


@query("""
select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title, len(regexp_extract_all(html, '<a href='))::int n_links from pages""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fields extracted from raw texts."""
    p = Tables(spark, sf_dir).pages
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).alias("n_links"))


# classification


@query(f"""with {EDGES}, d as (select node, sum(i) i, sum(o) o from (select dst node, 1 i, 0 o from edges union all select src, 0, 1 from edges) group by 1)
select s_suppkey, case when coalesce(i, 0) = 0 then 'entry_point' when coalesce(o, 0) = 0 then 'io_primitive' when i >= 8 and s_acctbal > 0 then 'api_boundary' when s_acctbal < 0 then 'persistence' else 'internal' end as "role" from supplier left join d on node = s_suppkey""")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of given rules that matches."""
    t = Tables(spark, sf_dir)
    x = t.supplier.join(G.degrees(supplier_edges(t)).withColumnRenamed("node", "s_suppkey"), "s_suppkey", "left")
    i, o = F.coalesce("in_degree", F.lit(0)), F.coalesce("out_degree", F.lit(0))
    rules = [("entry_point", i == 0), ("io_primitive", o == 0), ("api_boundary", (i >= 8) & (F.col("s_acctbal") > 0)), ("persistence", F.col("s_acctbal") < 0)]
    return x.select("s_suppkey", K.first_match(rules, "internal").alias("role"))


@query("""
select user_id, bool_or(event_type = 'error' and value > 50) concurrency, bool_or(event_type = 'purchase' and (props->>'k')::int > 95) security_boundary from events group by 1""")
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that need a second signal, by given rules."""
    e = Tables(spark, sf_dir).events
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > 50)).alias("concurrency"), F.bool_or((F.col("event_type") == "purchase") & (k > 95)).alias("security_boundary"))


@query("""
with x as (select user_id, bool_or(event_type = 'signup' and value > 60) a, bool_or(event_type = 'error' and value > 80) b, bool_or(event_type = 'purchase' and value > 100) c, bool_or(event_type = 'view' and value > 100) d from events group by 1),
r as (select user_id, list_filter([case when a then 'create' end, case when b then 'delete' end, case when c then 'mutate' end, case when d then 'read' end], lambda z: z is not null) l from x)
select user_id, l[1] as "primary", array_to_string(l, ',') roles, len(l) > 1 mixed from r""")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each owner, in the order of given rules."""
    t, v = F.col("event_type"), F.col("value")
    rules = [("create", (t == "signup") & (v > 60)), ("delete", (t == "error") & (v > 80)), ("mutate", (t == "purchase") & (v > 100)), ("read", (t == "view") & (v > 100))]
    x = K.lifecycle(Tables(spark, sf_dir).events, "user_id", rules)
    return x.select("user_id", "primary", F.array_join("roles", ",").alias("roles"), "mixed")


# time


@query("""
with x as (select user_id, ts, event_type, lag(ts) over (partition by user_id order by ts) p from events), s as (select *, sum((p is null or ts >= p + interval 6 hours)::int) over (partition by user_id order by ts rows unbounded preceding) n from x)
select user_id, min(ts) "start", max(ts) + interval 6 hours "end", count(*)::bigint n_events, array_to_string(list_sort(list(distinct event_type)), ',') items from s group by user_id, n""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: bursts that end after a quiet gap."""
    x = S.debounced(Tables(spark, sf_dir).events, "ts", "user_id", "event_type", "6 hours")
    return x.select("user_id", "start", "end", "n_events", F.array_join("items", ",").alias("items"))


@query("""select user_id, time_bucket(interval 5 minutes, ts) "start", count(*)::bigint n_events from events group by 1, 2""")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12: fixed windows of five minutes."""
    return S.tumbling(Tables(spark, sf_dir).events, "ts", "user_id")
