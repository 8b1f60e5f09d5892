"""Labels by rules over an index whose names, signatures, imports and references meet every rule; with their SQL.

``part`` gives the symbols (``rs``) and imports (``ri``), each line of an order a call (``rc``) and a
reference (``rr``) from its part to the part of the order's next line. All rows take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import exprs as E
from codeloom.operators import aggregates as A
from codeloom.operators import classify as K
from codeloom.operators import lookup as L
from codeloom.operators.ranks import numbered
from codeloom.plans.registry import Tables, query

NAMES = ["main", "RunE", "init", "Execute", "ServeIt", "ReadAll", "NewStore", "NewThing", "Query", "exec", "Commit", "SaveContext", "loadRow", "PutRow", "LockAll", "isError", "DeleteRow", "RemoveAll", "CreateRow", "MakeIt", "UpdateRow", "SetField", "AddItem", "HasIt", "runJob", "Close", "DB", "store.Get", "CheckAll"]
KINDS = ["func", "func", "method", "struct", "method", "interface", "var"]
SIGNATURES = [
    "func(w http.ResponseWriter, r *http.Request)", "func(c *gin.Context)", "func Read(p []byte) (n int, err error)", "func Close() error", "func New(path string) *Store", "func New(path string) (*Store, error)", "func(ch chan<- int)", "func(exchange Exchange)", "func(t *@) error", "func() @",
    "func(x int) (*@, error)", "func()", "func(c echo.Context) error", "func(t @x)", "func Write(b []byte, n int)", "ServeHTTP(x)", None,
]
PLACES = ["/store", "/main", "/cmd/x", "", "/Datastore/y", "/database/sql", "/util", "/http"]
CONTEXTS = ["go", "chan", "call:Lock", "call:Command", "call:ListenAndServe", "lit", "new", "make", "call:DeleteRow", "call:delete", "call:Exec", "call:Run", "call:Deletes", "call:Wait", "call:ExecContext", None, "sig", ""]
SNIPPETS = ["x", 'db.Exec("delete from t")', "c.InsecureSkipVerify = true", "y.Load()"]
PACKAGES = ["sync", "sync/atomic", "os/exec", "crypto/tls", "net/http", "fmt", "strings"]


def _sql(values: list) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


RS = f"""rs as materialized (select 's' || k id, k, p_size, case when kind in ('struct', 'interface') then 'T' || (k % 3) || case k % 4 when 0 then 'Reader' when 1 then 'bufWriterX' else '' end when kind = 'var' then 'v' else {_sql(NAMES)}[k % {len(NAMES)} + 1] end as name, kind,
 replace({_sql(SIGNATURES)}[k % {len(SIGNATURES)} + 1], '@', 'T' || (k % 3)) signature, case when kind = 'method' then '(*T)' end receiver, pkg pkg_path, pkg || case when k % 9 = 4 then '/a_test.go' when k % 11 = 3 then '/main.go' when k % 13 = 5 then '/zz_generated_x.go' when k % 17 = 6 then '/b_gen.go' else '/f' || (k % 4) || '.go' end file_path
 from (select p_partkey k, p_size, {_sql(KINDS)}[p_partkey % {len(KINDS)} + 1] kind, 'app/' || lower(replace(p_brand, '#', '')) || {_sql(PLACES)}[p_size % {len(PLACES)} + 1] pkg from part))"""
_NEXT = "lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
RL = f"rl as materialized (select *, {_NEXT} nxt from lineitem)"
RC = "rc as materialized (select 's' || l_partkey caller_id, 's' || nxt callee_id from rl where nxt is not null)"
RR = f"""rr as materialized (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || nxt || '-' || l_suppkey id, 's' || nxt symbol_id, case when l_suppkey % 10 <> 3 then 's' || l_partkey when l_suppkey % 20 = 3 then '' end enclosing_id, f.file_path, l_linenumber line,
 {_sql(CONTEXTS)}[(l_suppkey + l_partkey + l_linenumber) % {len(CONTEXTS)} + 1] ast_ctx, {_sql(SNIPPETS)}[l_linenumber % {len(SNIPPETS)} + 1] snippet from rl join rs f on f.k = l_partkey where nxt is not null)"""
RI = f"ri as materialized (select file_path, {_sql(PACKAGES)}[k % {len(PACKAGES)} + 1] pkg_path from rs)"


def _pick(values: list, place) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))


class Rules:
    """The tables of the index, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = t = Tables(spark, sf_dir)
        k, text = F.col("k"), lambda c: c.cast("string")
        kind, third = _pick(KINDS, k % len(KINDS)), F.concat(F.lit("T"), text(k % 3))
        pkg = F.concat(F.lit("app/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), _pick(PLACES, F.col("p_size") % len(PLACES)))
        file = F.when(k % 9 == 4, "/a_test.go").when(k % 11 == 3, "/main.go").when(k % 13 == 5, "/zz_generated_x.go").when(k % 17 == 6, "/b_gen.go").otherwise(F.concat(F.lit("/f"), text(k % 4), F.lit(".go")))
        suffix = F.when(k % 4 == 0, "Reader").when(k % 4 == 1, "bufWriterX").otherwise("")
        name = F.when(kind.isin("struct", "interface"), F.concat(third, suffix)).when(kind == "var", "v").otherwise(_pick(NAMES, k % len(NAMES)))
        parts = t.part.select(F.col("p_partkey").alias("k"), "p_size", "p_brand")
        self.symbols = parts.select(
            F.concat(F.lit("s"), text(k)).alias("id"), "k", "p_size", name.alias("name"), kind.alias("kind"), F.replace(_pick(SIGNATURES, k % len(SIGNATURES)), F.lit("@"), third).alias("signature"), F.when(kind == "method", "(*T)").alias("receiver"), pkg.alias("pkg_path"), F.concat(pkg, file).alias("file_path")
        )
        line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lead("l_partkey").over(line).alias("nxt")).filter("nxt is not null")
        ends = [F.concat(F.lit("s"), text(F.col(c))) for c in ("l_partkey", "nxt")]
        self.calls = lines.select(ends[0].alias("caller_id"), ends[1].alias("callee_id"))
        s = F.col("l_suppkey")
        inside = F.when(s % 10 != 3, ends[0]).when(s % 20 == 3, "")
        ctx = _pick(CONTEXTS, (s + F.col("l_partkey") + F.col("l_linenumber")) % len(CONTEXTS))
        self.refs = lines.join(self.symbols.select(F.col("k").alias("l_partkey"), "file_path"), "l_partkey").select(
            F.concat_ws("-", *(text(F.col(c)) for c in ("l_orderkey", "l_linenumber", "l_partkey", "nxt", "l_suppkey"))).alias("id"), ends[1].alias("symbol_id"), inside.alias("enclosing_id"), "file_path", F.col("l_linenumber").alias("line"), ctx.alias("ast_ctx"), _pick(SNIPPETS, F.col("l_linenumber") % len(SNIPPETS)).alias("snippet")
        )
        self.imports = self.symbols.select("file_path", _pick(PACKAGES, k % len(PACKAGES)).alias("pkg_path"))


ROLES = f"""c as (select callee_id id, bool_or(coalesce(f.name in ('main', 'init'), false)) started, count(*) n, count(*) filter (f.pkg_path = o.pkg_path) own, count(*) filter (f.pkg_path <> o.pkg_path) other from rc join rs o on o.id = callee_id left join rs f on f.id = caller_id group by 1),
q as (select distinct caller_id id from rc join rs o on o.id = callee_id where o.name in ('Query', 'QueryRow', 'Exec', 'Begin', 'Commit', 'Rollback', 'Prepare') or o.pkg_path ilike '%database/sql%'),
ro as (select rs.id, case when name = 'main' and ends_with(pkg_path, '/main') or name = 'RunE' and kind = 'method' or name = 'init' or coalesce(started, false) or name = 'Execute' and kind = 'method' then 'entry_point'
 when signature ilike '%servehttp%' or signature ilike '%responsewriter%' and signature ilike '%request%' or contains(lower(signature), '*gin.context') or contains(lower(signature), 'echo.context') then 'handler'
 when contains(lower(signature), 'read(') and contains(signature, '[]byte') and signature ilike '%int%' or contains(lower(signature), 'write(') and contains(signature, '[]byte') and signature ilike '%int%' or contains(lower(signature), 'close()') and signature ilike '%error%' then 'io_primitive'
 when starts_with(name, 'New') and contains(regexp_extract(signature, '[)]([^)]*)$', 1), '*') then 'factory' when pkg_path ilike '%store%' or q.id is not null then 'persistence' when regexp_matches(name, '^[A-Z]') and coalesce(other, 0) > 0 then 'api_boundary' when not regexp_matches(name, '^[A-Z]') or coalesce(n, 0) = 0 or own = n then 'internal' else 'api_boundary' end as "role"
 from rs left join c using (id) left join q on q.id = rs.id where kind in ('func', 'method'))"""
FLAGS = """i as (select file_path, bool_or(pkg_path in ('sync', 'sync/atomic')) a, bool_or(pkg_path = 'os/exec') b, bool_or(pkg_path = 'crypto/tls') c, bool_or(pkg_path = 'net/http') d from ri group by 1),
e as (select enclosing_id id, bool_or(ast_ctx in ('go', 'chan')) g, bool_or(ast_ctx in ('call:Lock', 'call:Unlock', 'call:RLock', 'call:RUnlock', 'call:Wait', 'call:Do', 'call:Add', 'call:Done', 'call:Store', 'call:Load')) a, bool_or(ast_ctx in ('call:Command', 'call:CommandContext', 'call:Run', 'call:Start', 'call:Output', 'call:CombinedOutput')) b,
 bool_or(snippet like '%InsecureSkipVerify%') c, bool_or(ast_ctx in ('call:ListenAndServe', 'call:ListenAndServeTLS', 'call:Serve')) d from rr where enclosing_id is not null group by 1),
fl as (select rs.id, coalesce(regexp_matches(signature, '(^|[^A-Za-z0-9_])chan([^A-Za-z0-9_]|$)'), false) or coalesce(g, false) or coalesce(i.a and e.a, false) concurrency, coalesce(i.b and e.b, false) or coalesce(i.c and e.c, false) or coalesce(i.d and e.d, false) security_boundary from rs left join e using (id) left join i on i.file_path = rs.file_path where kind in ('func', 'method'))"""


@query(f"with {RS}, {RL}, {RC}, {ROLES} select * from ro")
def structural_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K4: the structural role of each function, the first rule that holds."""
    r = Rules(spark, sf_dir)
    return K.roles(K.call_facts(r.symbols, r.calls)).select("id", "role")


@query(f"with {RS} select id, case when pkg_path ilike '%store%' then 'persistence' when name ilike '%reader%' or name ilike '%writer%' then 'io_primitive' when regexp_matches(name, '^[A-Z]') then 'api_boundary' else 'internal' end as \"role\" from rs where kind in ('struct', 'interface')")
def type_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the role of each type."""
    return K.type_roles(Rules(spark, sf_dir).symbols).select("id", "role")


@query(f"with {RS}, {RL}, {RR}, {RI}, {FLAGS} select * from fl")
def concurrency_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: risks of functions by what they hold, beside what their files import."""
    r = Rules(spark, sf_dir)
    return K.risk_flags(r.symbols, r.refs, r.imports)


@query(f"""with {RS}, {RL}, {RC}, {RR}, {RI}, {ROLES}, {FLAGS}, n as (select symbol_id id, count(*) n from rr group by 1), w as (select id, "role", coalesce(n, 0) n, greatest(case "role" when 'entry_point' then 10 when 'api_boundary' then 5 when 'persistence' then 5 when 'handler' then 5 when 'factory' then 3 when 'io_primitive' then 3 else 1 end, case when security_boundary then 6 else 0 end, case when concurrency then 5 else 0 end)::double w
 from ro join fl using (id) left join n using (id)) select id, "role", round((ln(1 + n) + 1) * w, 6) priority from w order by priority desc, id limit 60""")
def usage_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ln(references + 1) + 1) times the largest weight of role and risks."""
    r = Rules(spark, sf_dir)
    x = K.roles(K.call_facts(r.symbols, r.calls)).select("id", "role").join(K.risk_flags(r.symbols, r.refs, r.imports), "id")
    x = A.use_counts(x, r.refs, "id", "symbol_id", "n")
    priority = F.round(E.usage_priority(F.col("n"), K.weight(F.col("role"), F.col("concurrency"), F.col("security_boundary"))), 6)
    return x.select("id", "role", priority.alias("priority")).orderBy(F.col("priority").desc(), "id").limit(60)


@query(f"""with {RS}, p as (select *, case when name = 'main' then 1 when name = 'Execute' then 2 when regexp_matches(name, '^run[A-Z]') and contains(file_path, '/cmd/') then 3 end p from rs where kind in ('func', 'method') and not ends_with(file_path, '_test.go')),
m as (select distinct file_path from rs where name = 'main' and kind = 'func' and receiver is null and ends_with(file_path, '/main.go') order by 1 limit 5)
select 'symbol' part, id, case when name = 'main' then split_part(pkg_path, '/', -1) end container, name, p::int priority, row_number() over (order by p, name, file_path, id)::int place from p where p is not null union all select 'file', file_path, null, null, null, row_number() over (order by file_path)::int from m""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where programs start: symbols in order of priority, main functions named by their package, and the
    first five main files."""
    s = Rules(spark, sf_dir).symbols
    found = numbered(K.entry_points(s), ["priority", "name", "file_path", "id"], "place")
    container = F.when(F.col("name") == "main", E.short_package(F.col("pkg_path")))
    rows = found.select(F.lit("symbol").alias("part"), "id", container.alias("container"), "name", "priority", F.col("place").cast("int").alias("place"))
    files = K.main_files(s).withColumn("place", F.row_number().over(Window.orderBy("file_path")))  # five rows
    none = F.lit(None).cast("string")
    return rows.unionByName(files.select(F.lit("file").alias("part"), F.col("file_path").alias("id"), none.alias("container"), none.alias("name"), none.cast("int").alias("priority"), "place"))


@query(f"""with {RS}, {RL}, {RR}, ty as (select id, name from rs where kind in ('struct', 'interface')), x as (select rr.id ref_id, symbol_id, ty.name t, nullif(enclosing_id, '') enc, rr.file_path, line, coalesce(ast_ctx, '') c, snippet from rr join ty on ty.id = symbol_id),
u as (select *, ends_with(file_path, '_test.go') or ends_with(file_path, '_gen.go') or contains(file_path, '/zz_generated_') test, c in ('lit', 'new', 'make') made, starts_with(c, 'call:') and (c = 'call:delete' or regexp_matches(c, '^call:(Delete|Remove|Drop|Purge)([A-Z]|$)') or c in ('call:Exec', 'call:ExecContext') and upper(snippet) like '%DELETE%') gone from x),
g as (select symbol_id, t, enc, bool_or(gone) gone, bool_or(made) made, arg_min(test, (file_path, line, ref_id)) test from u where enc is not null group by 1, 2, 3), h as (select g.*, coalesce(f.name, '') fn, coalesce(f.signature, '') sig from g left join rs f on f.id = enc),
l as (select *, list_filter([case when gone then 'delete' end, case when made then 'create' end, case when regexp_matches(fn, '^(New|Make|Build|Create)([A-Z]|$)') and regexp_matches(sig, '[)]\\s*([(]\\s*)?[*]?\\b' || t || '\\b') then 'create' end, case when regexp_matches(fn, '^(Delete|Remove|Archive|Drop|Purge)([A-Z]|$)') then 'delete' end,
 case when regexp_matches(fn, '^(Set|Update|Add|Append|Put|Upsert|Merge)([A-Z]|$)') and regexp_matches(sig, '[*]\\s*\\b' || t || '\\b') then 'mutate' end], lambda z: z is not null) l from h)
select symbol_id, enc enclosing_id, null::varchar ref_id, coalesce(l[1], 'read') "role", array_to_string(list_filter(['create', 'delete', 'mutate'], lambda z: list_contains(l, z) and z <> l[1]), ',') mixed, test is_test from l union all select symbol_id, null, ref_id, case when made then 'create' else 'type-use' end, '', test from u where enc is null""")
def type_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each function does with each type that it refers to, by the rules in their order."""
    r = Rules(spark, sf_dir)
    types = r.symbols.filter(F.col("kind").isin("struct", "interface")).select(F.col("id").alias("symbol_id"), F.col("name").alias("type_name"))
    return K.type_lifecycles(r.refs, r.symbols, types).withColumn("mixed", F.array_join(F.array_sort("mixed"), ","))


@query(f"""with {RS}, {RL}, {RC}, d as (select distinct caller_id, name from rc join rs o on o.id = callee_id where o.kind in ('func', 'method')), w as (select *, 5 - case when regexp_extract(name, '([^.]*)$', 1) in ('DB', 'Close', 'String', 'Error', 'Err', 'Bytes', 'Len', 'Reset') then 4 else 0 end + case when contains(name, '.') then 3 else 0 end
 + case when regexp_matches(name, '(^|[.])[A-Z][^.]*$') then 2 else 0 end - case when regexp_matches(lower(name), '(^|[.])(is|has)[^.]*$') then 2 else 0 end s from d), r as (select *, row_number() over (partition by caller_id order by s desc, name) n from w)
select caller_id, name, s::int significance, n::int place, case {" ".join(f"when name = '{k}' then '{v}'" for k, v in E.VERBS.items())} {" ".join(f"when starts_with(name, '{k}') then '{v}'" for k, v in E.VERB_PREFIXES.items())} else 'calls' end verb,
 case when name ilike '%context%' then 'context propagation' when name ilike '%error%' then 'error handling' when regexp_matches(name, '^(Lock|Unlock)') then 'synchronization' when regexp_matches(name, '^(Close|Release)') then 'resource cleanup' end note from r where n <= 5""")
def ranked_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five callees of each function that tell most, with their verb and note."""
    r = Rules(spark, sf_dir)
    names = r.symbols.filter(F.col("kind").isin("func", "method")).select(F.col("id").alias("callee_id"), "name")
    x = r.calls.join(names, "callee_id").select("caller_id", "name").distinct().withColumn("significance", E.significance(F.col("name")))
    x = L.top_per_group(x, ["caller_id"], [F.col("significance").desc(), "name"], 5)
    return x.select("caller_id", "name", "significance", F.col("rank").cast("int").alias("place"), E.action_verb(F.col("name")).alias("verb"), E.callee_note(F.col("name")).alias("note"))


_HALF = "case when {0} > 0 then {0} / ({0} + {1}.0) when {0} <= 0 then 0.0::double end"


@query(f"""with o as (select o_custkey k, count(*) n, count(distinct o_orderpriority) p, count(*) filter (o_orderstatus = 'F') f, count(*) filter (o_orderstatus = 'P') r, count(*) filter (o_orderstatus = 'O') e, count(*) filter (o_orderpriority = '5-LOW') u, count(*) filter (o_orderpriority <> '1-URGENT') c from orders group by 1),
m as (select c_custkey k, n, p, f, r, e, u, c, case when c_nationkey % 3 > 0 then c_nationkey + 1 end rk, 25 rc, case when c_nationkey % 4 > 0 then n * 3 end cy, case when c_nationkey % 4 > 0 then p * 5 end cg, case when c_acctbal >= 0 then floor(c_acctbal / 1000) end b, case when c_acctbal >= 0 then c_acctbal / 400 end h from customer left join o on o.k = c_custkey)
, w as (select k, n is null no, case when n is not null then case when rk is null then ({_HALF.format('n', 20)} + {_HALF.format('p', 5)}) / 2 else ({_HALF.format('n', 20)} + {_HALF.format('p', 5)} + (rc - rk + 1) / rc) / 3 end end reach, case when n is not null then ({_HALF.format('cy', 10)} + {_HALF.format('cg', 15)}) / 2 end difficulty,
 case when n is not null then ({_HALF.format('b', 5)} + {_HALF.format('h', 10)}) / 2 end history, case when n is not null then ({_HALF.format('f', 1)} + {_HALF.format('r', 3)} + {_HALF.format('e', 3)}) / 3 end kind, case when c > 0 then u / c end safety_net from m)
select k c_custkey, floor(reach * 1000 + 0.5) / 1000 reach, floor(difficulty * 1000 + 0.5) / 1000 difficulty, floor(history * 1000 + 0.5) / 1000 history, floor(kind * 1000 + 0.5) / 1000 kind, floor(safety_net * 1000 + 0.5) / 1000 safety_net,
 floor((0.0::double + coalesce(reach, 0) + coalesce(difficulty, 0) + coalesce(history, 0) + coalesce(kind, 0) + coalesce(safety_net, 0)) / nullif((reach is not null)::int + (difficulty is not null)::int + (history is not null)::int + (kind is not null)::int + (safety_net is not null)::int, 0) * 1000 + 0.5) / 1000 risk from w""".replace("/ rc)", "/ rc::double)").replace("u / c end", "u / c::double end"))
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five factors of changes and their mean, without those that are missing; null where nothing could be measured."""
    t = Tables(spark, sf_dir)
    n = lambda cond: F.count(F.when(cond, 1))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("callers"), F.countDistinct("o_orderpriority").alias("importers"), n(status == "F").alias("flags"), n(status == "P").alias("roles"), n(status == "O").alias("exported"), n(priority == "5-LOW").alias("untested"), n(priority != "1-URGENT").alias("changed_funcs")
    )
    x, nation, balance = t.customer.join(o, "c_custkey", "left"), F.col("c_nationkey"), F.col("c_acctbal")
    x = x.withColumns({
        "pkg_rank": F.when(nation % 3 > 0, nation + 1), "pkg_count": F.lit(25), "cyclo": F.when(nation % 4 > 0, F.col("callers") * 3), "cognitive": F.when(nation % 4 > 0, F.col("importers") * 5),
        "bug_commits": F.when(balance >= 0, F.floor(balance / 1000)), "churn": F.when(balance >= 0, balance / 400), "degraded": F.when(F.col("callers").isNull(), "no change"),
    })
    return K.assessed(x).select("c_custkey", "reach", "difficulty", "history", "kind", "safety_net", F.col("score").alias("risk"))
