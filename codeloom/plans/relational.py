"""Lookups, joins, aggregates, windows and set operators, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import exprs as E
from codeloom.lineage import cut
from codeloom.literals import literal_rows
from codeloom.operators import aggregates as A
from codeloom.operators import graph as G
from codeloom.operators import lookup as L
from codeloom.operators import relations as R
from codeloom.plans.registry import Tables, query


#: A day in microseconds.
DAY = 86_400_000_000


def supplier_edges(t: Tables) -> DataFrame:
    """Suppliers of successive lines of an order, over all lines."""
    a = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("src"))
    b = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dst"))
    return G.simple_edges(a.join(b, ["l_orderkey", "l_linenumber"]), "src", "dst")


EDGES = """edges as materialized (select distinct a.l_suppkey src, b.l_suppkey dst from lineitem a join lineitem b
  on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_suppkey <> b.l_suppkey)"""


# names and lists

NAMES = ["red widget", "Red Widget", "SMALL RING", "widg", "no such part"]


@query("""
with part_names as (select distinct p_name from part),
q(query) as (values ('red widget'), ('Red Widget'), ('SMALL RING'), ('widg'), ('no such part')),
c as (select query, p_name, case when p_name = query then 1 when lower(p_name) = lower(query) then 2 when contains(lower(p_name), lower(query)) then 3 end tier from q, part_names),
b as (select *, min(tier) over (partition by query) best from c where tier is not null)
select query, p_name, tier::int tier from b where tier = best""")
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact name, else equal but for case, else containing."""
    t = Tables(spark, sf_dir)
    inputs = literal_rows(spark, [(n,) for n in NAMES], "query string")
    names = t.part.select("p_name").distinct()
    return L.by_name(inputs, names, name="p_name").select("query", "p_name", F.col("tier").cast("int").alias("tier"))


@query("""
with p as (select p_partkey, p_name, 'pkg/' || p_brand pkg from part),
q(query_pkg, query_name) as (values ('pkg/Brand#2', 'small ring'), ('Brand#17', 'red widget'), ('rand#17', 'red widget')),
c as (select q.*, p_partkey, case when pkg = query_pkg then 1 when ends_with(pkg, '/' || query_pkg) then 2 end tier from q join p on p_name = query_name),
b as (select *, min(tier) over (partition by query_pkg, query_name) best from c where tier is not null)
select query_pkg, query_name, p_partkey, tier::int tier from b where tier = best""")
def qualified_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact package, else its suffix after a slash."""
    t = Tables(spark, sf_dir)
    inputs = literal_rows(spark, [("pkg/Brand#2", "small ring"), ("Brand#17", "red widget"), ("rand#17", "red widget")], "query_pkg string, query_name string")
    parts = t.part.select("p_partkey", F.col("p_name").alias("name"), F.concat(F.lit("pkg/"), "p_brand").alias("pkg_path"))
    return L.qualified(inputs, parts).select("query_pkg", "query_name", "p_partkey", F.col("tier").cast("int").alias("tier"))


@query("select p_partkey, p_name from part where contains(lower(p_name), 'gear') order by length(p_name), p_name, p_partkey limit 40")
def substring_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that contain a text, shortest first."""
    return L.substring_ranked(Tables(spark, sf_dir).part.select("p_partkey", "p_name"), "GEAR", "p_name", ["p_name", "p_partkey"], 40)


@query("""
select p_partkey, p_type, (case p_type when 'PROMO' then 0 when 'LARGE' then 1 when 'MEDIUM' then 2 else 3 end)::int priority from part
where p_brand = 'Brand#2' order by priority, p_partkey limit 50 offset 5""")
def kind_priority_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a package's symbols by priority of kind."""
    x = Tables(spark, sf_dir).part.filter("p_brand = 'Brand#2'").select("p_partkey", "p_type", E.kind_priority(F.col("p_type"), ["PROMO", "LARGE", "MEDIUM"]).alias("priority"))
    return L.page(x, ["priority", "p_partkey"], 50, 5)


@query("""
select p_partkey, p_name, round((case when lower(p_name) = 'red widget' then 100.0::double when starts_with(lower(p_name), 'red widget') then 50.0 when contains(lower(p_name), 'red widget') then 25.0 else 0.0 end)
 + (case when regexp_matches(p_name, '^[A-Z]') then 20.0 else 0.0 end) + 10.0 * (1 - least(length(p_type), 100) / 100.0), 6) score
from part order by score desc, p_name, p_partkey limit 60""")
def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance score, top k."""
    x = Tables(spark, sf_dir).part.select("p_partkey", "p_name", F.round(E.relevance(F.col("p_name"), "Red Widget", path=F.col("p_type")), 6).alias("score"))
    return x.orderBy(F.col("score").desc(), "p_name", "p_partkey").limit(60)


@query("""
with i(id) as (values (1), (5), (5), (77), (999999999))
select p_partkey, p_name, p_brand from part where p_partkey in (select id from i)""")
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for a list of ids, repeated and unknown ones included."""
    ids = literal_rows(spark, [(i,) for i in (1, 5, 5, 77, 999999999)], "p_partkey long")
    return L.batch_lookup(ids, Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_brand"), "p_partkey")


@query("""
select p_partkey, substr(sha256(concat_ws(':', p_partkey, p_name, p_brand)), 1, 16) id, regexp_extract(p_brand, '#([0-9]+)$', 1) brand_no,
 ceil(strlen(p_name) / 4.0)::bigint tokens, (case when length(p_name) <= 3 then 1 when length(p_name) <= 6 then 2 when length(p_name) <= 12 then 3 else 4 end)::int max_distance
from part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar family: identity hash, extraction, token estimate, distance bound."""
    p = Tables(spark, sf_dir).part
    return p.select(
        "p_partkey", E.symbol_id(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand")).alias("id"), F.regexp_extract("p_brand", "#([0-9]+)$", 1).alias("brand_no"),
        E.token_estimate(F.col("p_name")).cast("long").alias("tokens"), E.max_distance(F.col("p_name")).cast("int").alias("max_distance"),
    )


# counts and usage


@query("""
select p_partkey, count(l_partkey)::bigint n_uses from part left join (select l_partkey from lineitem) l on l_partkey = p_partkey group by 1""")
def ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: uses of each item, zeros kept."""
    t = Tables(spark, sf_dir)
    return A.use_counts(t.part.select("p_partkey"), t.lineitem.select("l_partkey"), "p_partkey", "l_partkey")


@query("""
with r as (select l_partkey k, count(*) n from lineitem group by 1), c as (select l_partkey k, count(distinct l_suppkey) n from lineitem group by 1)
select p_partkey, coalesce(r.n, 0)::bigint refs, coalesce(c.n, 0)::bigint calls, (coalesce(r.n, 0) + coalesce(c.n, 0))::bigint usage from part
left join r on r.k = p_partkey left join c on c.k = p_partkey order by usage desc, p_partkey limit 100""")
def usage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by the sum of two counts, each aggregated before its join."""
    t = Tables(spark, sf_dir)
    n = lambda count: t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(count.alias("n"))
    x = A.usage_rank(t.part.select("p_partkey"), "p_partkey", [("refs", n(F.count(F.lit(1)))), ("calls", n(F.countDistinct("l_suppkey")))])
    return x.orderBy(F.col("usage").desc(), "p_partkey").limit(100)


@query("""
with x as (select l_partkey p, sum(l_quantity) complexity, count(distinct l_orderkey) churn from lineitem group by 1), m as (select max(complexity) mx, max(churn) mn from x)
select p_partkey, p_name, round(complexity, 4) complexity, churn::bigint churn, round((case when mx > 0 then complexity / mx else 0 end) * (case when mn > 0 then ln(1 + churn) / ln(1 + mn) else 0 end), 6) score
from x join part on p_partkey = p, m order by score desc, p_partkey limit 100""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity times churn, the flagship query."""
    t = Tables(spark, sf_dir)
    both = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("complexity"), F.countDistinct("l_orderkey").alias("churn"))
    x = A.scored_hotspots(both).join(t.part.select("p_partkey", "p_name"), "p_partkey")
    x = x.select("p_partkey", "p_name", F.round("complexity", 4).alias("complexity"), "churn", F.round("score", 6).alias("score"))
    return x.orderBy(F.col("score").desc(), "p_partkey").limit(100)


@query("""
with l as (select distinct s.s_nationkey a, c.c_nationkey b, l.l_suppkey k from lineitem l join supplier s on s.s_suppkey = l.l_suppkey join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey)
select a src_nation, b dst_nation, count(distinct k)::bigint n_units from l where a <> b group by 1, 2""")
def deps_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency edges with the number of distinct units behind them."""
    t = Tables(spark, sf_dir)
    x = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("src_nation")), "s_suppkey")
    x = x.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(t.customer.select("c_custkey", F.col("c_nationkey").alias("dst_nation")), "c_custkey")
    return A.dependency_edges(x, "src_nation", "dst_nation", "s_suppkey")


@query(f"with {EDGES} select dst, count(distinct src)::bigint fan_in from edges group by 1")
def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct other sources of each target."""
    return A.fan_in(supplier_edges(Tables(spark, sf_dir)))


@query("""
select p_brand, round(sum(l_extendedprice), 2) total, round(quantile_cont(l_extendedprice, 0.95), 4) p95, max(l_extendedprice) largest, count(*)::bigint n
from lineitem join part on p_partkey = l_partkey group by 1""")
def rollup_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, interpolated 95th percentile and maximum."""
    t = Tables(spark, sf_dir)
    x = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_extendedprice").join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    return A.rollup(x, ["p_brand"], "l_extendedprice").select("p_brand", F.round("total", 2).alias("total"), F.round("p95", 4).alias("p95"), "largest", "n")


@query("""
select p_brand, sum(case when p_type = 'PROMO' then 1 else 0 end)::bigint n_abstract, count(*)::bigint n_counted, round(sum(case when p_type = 'PROMO' then 1 else 0 end) / count(*), 6) abstractness
from part where p_type in ('PROMO', 'LARGE', 'SMALL') group by 1""")
def abstractness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: share of abstract kinds among those that count."""
    x = A.abstractness(Tables(spark, sf_dir).part, ["p_brand"], F.col("p_type") == "PROMO", F.col("p_type").isin("PROMO", "LARGE", "SMALL"))
    return x.withColumn("abstractness", F.round("abstractness", 6))


@query("""
with m as (select max(ts) now from events)
select user_id, count(*)::bigint commits, count(distinct event_type)::bigint authors, min(ts)::date first_seen, max(ts)::date last_changed,
 round(sum(pow(2.0, -(epoch_us(now) - epoch_us(ts)) / 86400000000.0 / 7.0)), 6) score, sum((event_type = 'error')::int)::bigint error_commits, sum((event_type = 'purchase')::int)::bigint purchase_commits
from events, m group by 1""")
def churn_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, authors, dates, decayed score, counts by type."""
    x = A.churn(Tables(spark, sf_dir).events, "user_id", "ts", "event_type", "event_type", 7.0, ["error", "purchase"])
    return x.withColumn("score", F.round("score", 6))


@query("select event_type, count(*)::bigint calls, sum((value < 5)::int)::bigint errors, round(sum((value < 5)::int) * 100.0 / count(*), 6) error_percent, list_sort(list(value))[count(*) // 2 + 1] p50_ms from events group by 1")
def usage_p50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, errors and upper median per command."""
    log = Tables(spark, sf_dir).events.select(F.col("event_type").alias("cmd"), F.when(F.col("value") < 5, "error").otherwise("ok").alias("outcome"), F.col("value").alias("ms"))
    return A.usage_report(log).select(F.col("cmd").alias("event_type"), "calls", "errors", F.round("error_percent", 6).alias("error_percent"), "p50_ms")


@query("""
with x as (select o_orderpriority p, sum((o_orderstatus = 'F')::int) yes, sum((o_orderstatus <> 'F')::int) no from orders group by 1)
select p convention, yes::bigint n_yes, no::bigint n_no, round(greatest(yes, no) / (yes + no), 6) ratio,
 case when greatest(yes, no) / (yes + no) >= 0.8 and yes + no >= 3 then 'high' when greatest(yes, no) / (yes + no) >= 0.6 and yes + no >= 3 then 'medium' else 'low' end confidence from x""")
def conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of the majority form, with confidence."""
    x = A.conventions(Tables(spark, sf_dir).orders.withColumnRenamed("o_orderpriority", "convention"), "convention", F.col("o_orderstatus") == "F")
    return x.withColumn("ratio", F.round("ratio", 6))


@query("""
with f as (select p_brand, p_name, min(p_size) doc from part group by all)
select p_brand, array_to_string(list_sort(list(distinct p_name)), ',') exports, min(doc) doc from f group by 1""")
def exports_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct names of each group, with the smallest doc."""
    x = Tables(spark, sf_dir).part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("e"), F.min("p_size").alias("doc"))
    return x.select("p_brand", F.array_join("e", ",").alias("exports"), "doc")


@query("""
select count(*)::bigint n_symbols, count(distinct p_brand)::bigint n_packages, count(distinct p_name)::bigint n_names, coalesce(sum(p_size), 0)::bigint n_lines from part""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the store."""
    return Tables(spark, sf_dir).part.agg(F.count(F.lit(1)).alias("n_symbols"), F.countDistinct("p_brand").alias("n_packages"), F.countDistinct("p_name").alias("n_names"), F.coalesce(F.sum("p_size"), F.lit(0)).cast("long").alias("n_lines"))


# joins


@query(f"""with {EDGES} select src, dst, a.s_name caller_s_name, b.s_name callee_s_name from edges join supplier a on a.s_suppkey = src join supplier b on b.s_suppkey = dst""")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the names of both ends."""
    t = Tables(spark, sf_dir)
    return R.calls(supplier_edges(t), t.supplier, "s_suppkey", ["s_name"]).select("src", "dst", "caller_s_name", "callee_s_name")


@query("""
select l.l_suppkey symbol_id, l.l_orderkey, l.l_linenumber, p.p_name enclosing_name, (case when l.l_returnflag = 'R' then 0 else 1 end)::int place from lineitem l left join part p on p.p_partkey = l.l_partkey""")
def refs_of_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every symbol with the enclosing one; those of a preferred place are place 0."""
    t = Tables(spark, sf_dir)
    x = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("enclosing_name")), "l_partkey", "left")
    return x.select(F.col("l_suppkey").alias("symbol_id"), "l_orderkey", "l_linenumber", "enclosing_name", F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("place"))


_HOPS = f"""with {EDGES}, seeds(seed) as (values (1), (2), (3), (5)),
one as (select distinct seed, src node from edges join seeds on dst = seed),
two as (select distinct o.seed, e.src node from one o join edges e on e.dst = o.node where e.src <> o.seed and (o.seed, e.src) not in (select seed, node from one))"""


@query(_HOPS + " select seed::bigint seed, node, 1 as hop from one union all select seed::bigint, node, 2 from two")
def impact_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, J6m, U1, U2: callers in one hop, and in two if not in one."""
    seeds = literal_rows(spark, [(1,), (2,), (3,), (5,)], "seed long")
    return R.two_hops(cut(supplier_edges(Tables(spark, sf_dir))), seeds)


@query(_HOPS + """, ph as (select node k, 0 p, 'caller' h from one union select node, 1, 'transitive' from two union select s_suppkey, 2, 'peer' from supplier where s_nationkey = 3)
select k node, min(p)::int first_phase, array_to_string(list(h order by p), ',') hints from (select distinct * from ph) group by 1""")
def impact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases merged by id; the first fixes the place, all leave hints."""
    t = Tables(spark, sf_dir)
    hops = R.two_hops(cut(supplier_edges(t)), literal_rows(spark, [(1,), (2,), (3,), (5,)], "seed long"))
    peers = t.supplier.filter("s_nationkey = 3").select(F.col("s_suppkey").alias("node"))
    x = R.merge_phases([("caller", hops.filter("hop = 1")), ("transitive", hops.filter("hop = 2")), ("peer", peers)], "node")
    return x.select("node", "first_phase", F.array_join("hints", ",").alias("hints"))


_CROSS = f"""with {EDGES}, g as (select s_suppkey node, 'layer' || (s_nationkey % 4) grp from supplier),
x as (select e.src, e.dst, a.grp from_grp, b.grp to_grp, s.s_name src_name from edges e join g a on a.node = e.src join g b on b.node = e.dst join supplier s on s.s_suppkey = e.src where a.grp <> b.grp)"""


def _crossings(t: Tables) -> DataFrame:
    groups = t.supplier.select(F.col("s_suppkey").alias("node"), F.concat(F.lit("layer"), (F.col("s_nationkey") % 4).cast("string")).alias("grp"))
    return R.crossings(supplier_edges(t), groups)


@query(_CROSS + " select src, dst, from_grp, to_grp from x")
def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References across sets."""
    return _crossings(Tables(spark, sf_dir)).select("src", "dst", "from_grp", "to_grp")


@query(_CROSS + " select from_grp, to_grp, count(*)::bigint n_crossings, count(distinct dst)::bigint n_targets from x group by 1, 2")
def layer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of layers."""
    return R.layer_matrix(_crossings(Tables(spark, sf_dir)), ["from_grp", "to_grp"])


@query(_CROSS + """, r(rule, from_grp, to_grp) as (values ('no-up', 'layer0', 'layer3'), ('no-side', 'layer1', 'layer2'))
select rule, src, dst from x join r using (from_grp, to_grp) where not (rule = 'no-up' and ends_with(src_name, '1'))""")
def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule violations, with allowed suffixes."""
    t = Tables(spark, sf_dir)
    x = _crossings(t).join(t.supplier.select(F.col("s_suppkey").alias("src"), F.col("s_name").alias("src_name")), "src")
    rules = literal_rows(spark, [("no-up", "layer0", "layer3"), ("no-side", "layer1", "layer2")], "rule string, from_grp string, to_grp string")
    return R.violations(x, rules, literal_rows(spark, [("no-up", "1")], "rule string, suffix string")).select("rule", "src", "dst")


@query("""
with need as (select distinct o_orderpriority p from orders), h as (select o_custkey, count(distinct o_orderpriority) n from orders group by 1)
select o_custkey c_custkey from h where n = (select count(*) from need)""")
def implementers_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of every required item."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return R.division(o, o.select("o_orderpriority").distinct(), ["c_custkey"], "o_orderpriority")


@query("""
select p_partkey, p_name, coalesce(n, 0)::bigint n_uses from part left join (select l_partkey, count(*) n from lineitem group by 1) l on l_partkey = p_partkey
where not exists (select 1 from lineitem q where q.l_partkey = p_partkey and q.l_quantity >= 50)""")
def dead_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a qualifying use, with the count of all uses."""
    t = Tables(spark, sf_dir)
    return R.dead(t.part.select("p_partkey", "p_name"), t.lineitem.select("l_partkey", "l_quantity"), "p_partkey", "l_partkey", F.col("l_quantity") >= 50)


@query("select count(*)::bigint n_orphans from events e where not exists (select 1 from customer c where c.c_custkey = e.user_id and c.c_acctbal > 5000)")
def orphan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, SK4: rows whose target is unknown."""
    t = Tables(spark, sf_dir)
    known = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return t.events.join(known, "user_id", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))


# intervals

_SPANS = """sp as (select event_id span_id, user_id, epoch_us(ts) s, epoch_us(ts) + (1 + event_id % 5) * 7200000000 e from events where event_type in ('view', 'signup'))"""


def _spans(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.filter("event_type in ('view', 'signup')").select(F.col("event_id").alias("span_id"), "user_id", us.alias("s"), (us + (1 + F.col("event_id") % 5) * 7200000000).alias("e"))


@query(f"""
with {_SPANS}, p as (select event_id point_id, user_id, epoch_us(ts) at_us from events where event_type = 'purchase'),
x as (select point_id, span_id, row_number() over (partition by point_id order by e - s, s, span_id) n from p join sp using (user_id) where s <= at_us and at_us <= e)
select point_id, span_id from x where n = 1""")
def enclosing_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest interval that holds each point."""
    t = Tables(spark, sf_dir)
    points = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("point_id"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return R.smallest_enclosing(points, _spans(t), ["user_id"], "at", "s", "e", "span_id", "point_id", width=DAY).select("point_id", "span_id")


@query("""
with p as (select event_id point_id, user_id, epoch_us(ts) at_us from events where event_type = 'purchase'), q as (select event_id next_id, user_id, epoch_us(ts) nx from events where event_type = 'error'),
x as (select point_id, next_id, row_number() over (partition by point_id order by nx, next_id) n from p join q using (user_id) where nx > at_us and nx <= at_us + 86400000000)
select point_id, next_id from x where n = 1""")
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next event within a day (bounded forward as-of)."""
    t = Tables(spark, sf_dir)
    points = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("point_id"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    after = t.events.filter("event_type = 'error'").select(F.col("event_id").alias("next_id"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("nx"))
    return R.next_within(points, after, ["user_id"], "at", "nx", F.col("at") + DAY, "point_id", ["next_id"], width=DAY).select("point_id", "next_id")


_SHIP = """shp as (select o_custkey k, o_orderkey id, datediff('day', date '1995-01-01', o_orderdate::date) s, datediff('day', date '1995-01-01', o_orderdate::date) + (o_orderkey % 40) e from orders)"""


def _shipping(t: Tables) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), day.cast("long").alias("s"), (day + F.col("o_orderkey") % 40).alias("e"))


@query(f"with {_SHIP} select a.k, a.id id_a, b.id id_b from shp a join shp b on a.k = b.k and a.id < b.id and a.s <= b.e and a.e >= b.s")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals of one key, joined by buckets."""
    x = _shipping(Tables(spark, sf_dir))
    a, b = x.select("k", F.col("id").alias("id_a"), F.col("s").alias("sa"), F.col("e").alias("ea")), x.select("k", F.col("id").alias("id_b"), F.col("s").alias("sb"), F.col("e").alias("eb"))
    return R.overlapping(a, b, ["k"], ("sa", "ea"), ("sb", "eb"), width=64).filter("id_a < id_b").select("k", "id_a", "id_b")


@query(f"""
with {_SHIP}, w as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) reach from shp),
i as (select *, sum((reach is null or s > reach + 1)::int) over (partition by k order by s, e rows unbounded preceding) island from w)
select k, min(s) "start", max(e) "end", count(*)::bigint n_ranges from i group by k, island""")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping or adjacent ranges as one."""
    return R.merged_ranges(_shipping(Tables(spark, sf_dir)), ["k"], "s", "e")


@query("""
with b as (select o_orderkey k, o_orderstatus v from orders where o_orderdate < timestamp '2000-01-01'), a as (select o_orderkey k, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end v from orders where o_orderdate >= timestamp '1996-01-01')
select coalesce(a.k, b.k) o_orderkey, case when b.k is null then 'added' when a.k is null then 'deleted' when a.v is not distinct from b.v then 'unchanged' else 'modified' end change from b full join a on a.k = b.k""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4, J34: added, modified, deleted, unchanged between two snapshots."""
    o = Tables(spark, sf_dir).orders
    before = o.filter("o_orderdate < timestamp '2000-01-01'").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    after = o.filter("o_orderdate >= timestamp '1996-01-01'").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return R.snapshot_diff(before, after, "o_orderkey", "v")


# windows and budgets


@query("""
with x as (select p_brand, l_partkey, count(*) n from lineitem join part on p_partkey = l_partkey group by all), r as (select *, row_number() over (partition by p_brand order by n desc, l_partkey) rank from x)
select p_brand, l_partkey, n::bigint n_refs, rank::int rank from r where rank <= 5""")
def concern_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each group."""
    t = Tables(spark, sf_dir)
    n = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_refs"))
    x = n.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return L.top_per_group(x, ["p_brand"], [F.col("n_refs").desc(), "l_partkey"], 5).select("p_brand", "l_partkey", "n_refs", F.col("rank").cast("int").alias("rank"))


@query("""
with x as (select p_brand, p_partkey, p_type = 'PROMO' ex, sum((p_type <> 'PROMO')::int) over (partition by p_brand order by p_size desc, p_partkey rows unbounded preceding) turn from part)
select p_brand, p_partkey from x where ex or turn <= 3""")
def capped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of each group, flagged rows exempt."""
    x = L.capped_with_exempt(Tables(spark, sf_dir).part, ["p_brand"], [F.col("p_size").desc(), "p_partkey"], F.col("p_type") == "PROMO", 3)
    return x.select("p_brand", "p_partkey")


@query("""
with x as (select source, doc_id, (ceil(strlen(text) / 4.0) + 50)::bigint tokens from documents), r as (select *, sum(tokens) over (partition by source order by doc_id rows unbounded preceding)::bigint running, row_number() over (partition by source order by doc_id) n from x)
select source, doc_id, tokens, running from r where running <= 4000 or n = 1""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of each group that fits a budget."""
    docs = Tables(spark, sf_dir).documents.select("source", "doc_id", (E.token_estimate(F.col("text")) + 50).cast("long").alias("size"))
    return L.token_budget(docs, F.col("size"), 4000, ["doc_id"], ["source"]).select("source", "doc_id", "tokens", "running")


@query("""
with d as (select ts::date as d, count(*) n from events group by 1), x as (select *, lag(n) over (order by d) p from d)
select d as "day", n::bigint n_events, p::bigint previous, case when p is null then '' when n < p then 'down' when n > p * 1.15 then 'up' else '' end delta from x""")
def history_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change to the day before."""
    x = Tables(spark, sf_dir).events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_events"))
    return A.with_delta(x, "n_events", ["day"])


@query("""
with x as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts, event_id) n from events) select user_id, event_type, event_id from x where n = 1""")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key."""
    return L.first_per_key(Tables(spark, sf_dir).events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(f"""with {EDGES}, d as (select node, sum(i) i, sum(o) o from (select dst node, 1 i, 0 o from edges union all select src, 0, 1 from edges) group by 1), m as (select node::varchar node_id, i::double in_d, o::double out_d from d)
select 'calls' graph_kind, node_id, 'in_degree' metric, in_d "value", row_number() over (order by in_d desc, node_id)::int rank from m union all select 'calls', node_id, 'out_degree', out_d, row_number() over (order by out_d desc, node_id)::int from m""")
def metric_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK10, W2, T7: long-format metrics with ranks."""
    d = G.degrees(supplier_edges(Tables(spark, sf_dir)))
    one = lambda c: A.ranked_metric(d.select("node", F.col(c).alias("value")), "calls", c)
    return one("in_degree").unionByName(one("out_degree"))


@query(f"""with {EDGES}, d as (select node, sum(i) i, sum(o) o from (select dst node, 1 i, 0 o from edges union all select src, 0, 1 from edges) group by 1)
select node::varchar node_id, i::double in_degree, o::double out_degree from d""")
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each metric."""
    return A.pivoted(metric_rank(spark, sf_dir), ["in_degree", "out_degree"])


@query("""
with m as (select date_trunc('week', ts) w, sum(value) v from events group by 1), x as (select w, v, lag(v) over (order by w) p from m), c as (select *, case when p <> 0 then (v - p) / p * 100 end ch from x)
select w as "week", round(v, 4) as "value", round(p, 4) as reference, case when ch > 15 then 'fail' when ch > 7.5 then 'warn' else 'pass' end verdict from c""")
def baseline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: pass, warn or fail against the value before."""
    x = Tables(spark, sf_dir).events.groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.sum("value").alias("value"))
    x = A.with_delta(x, "value", ["week"])
    change = E.percent_change(F.col("value"), F.col("previous"))
    return x.select("week", F.round("value", 4).alias("value"), F.round("previous", 4).alias("reference"), E.verdict(change).alias("verdict"))
