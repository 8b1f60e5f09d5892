"""Queries over source text that is read out of the driver's tables: signatures, searches, schemas, concurrency, conventions; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import code_text as T
from codeloom.lineage import shared_folder
from codeloom.operators import aggregates as A
from codeloom.operators import conventions as C
from codeloom.operators import graph as G
from codeloom.operators import relations as R
from codeloom.operators import source_text as X
from codeloom.plans.indexed import SYM, Code
from codeloom.plans.registry import Tables, query
from codeloom.sources import snapshots

#: Forms of signatures; @ is a name, # a number.
FORMS = [
    "func @()", "func @(f func(a int, b string) error, n int) (map[string]func(int, int), error)", "func (*T#) @(x []T, opts ...Option) error", "func (t T) @[K comparable, V any](m map[K]V, f func(K, V)) *Node[K, V]", "type @ struct",
    "func @(a struct{x, y int}, b interface{ M(int, int) }, c chan<- int) (r io.Reader, err error)", "", "func @(a int", "  func @( ) (  )", "func(w Writer) (int, error)", "func @(cb func(func(a, b int) (c, d int)) (e, f error)) func(x, y int)",
]
_FORM = "(case p_partkey % 11 " + " ".join(f"when {k} then '{f}'" for k, f in enumerate(FORMS)) + " end)"


@query(f"""with {SYM}, a as (select id, trim(regexp_replace(trim(replace(replace({_FORM.replace("p_partkey", "k")}, '@', name), '#', '' || p_size)), '^func', '')) t from sym),
d as (select id, i, c, sum(case c when '(' then 1 when ')' then -1 else 0 end) over (partition by id order by i) d from (select id, i, t[i] c from a, unnest(range(1, len(t) + 1)) x(i))), r as (select id, min(i) e from d where c = ')' and d = 0 group by 1),
u as (select a.id, case when t[1] = '(' and e > 1 then trim(t[e + 1:]) else t end t from a left join r using (id)), o as (select id, t, instr(t, '(') b from u), m as (select o.id, t, b, (select min(i) from (select i, t[i] c, sum(case t[i] when '(' then 1 when ')' then -1 else 0 end) over (order by i) d from unnest(range(b, len(t) + 1)) x(i)) where c = ')' and d = 0) e from o where b > 0),
p as (select id, 'p' s, t[b + 1:e - 1] l from m where e is not null union all select id, 'r', case when z[1] = '(' then z[2:len(z) - 1] else z end from (select id, trim(t[e + 1:]) z from m where e is not null)),
k as (select id, s, l, i, l[i] c, sum(case when l[i] in ('(', '[', '{{') then 1 when l[i] in (')', ']', '}}') then -1 else 0 end) over (partition by id, s order by i) d from p, unnest(range(1, len(l) + 1)) x(i)),
g as (select id, s, c, i, sum(case when c = ',' and d = 0 then 1 else 0 end) over (partition by id, s order by i) n, c = ',' and d = 0 cut from k), h as (select id, s, n, trim(string_agg(case when cut then '' else c end, '' order by i)) v from g group by 1, 2, 3), w as (select id, s, string_agg(v, ' | ' order by n) v, count(*) n from h where s || id not in (select s || id from p where trim(l) = '') group by 1, 2)
select a.id, coalesce(x.n, 0)::int n_params, coalesce(y.n, 0)::int n_results, coalesce(contains(q.l, '...'), false) "variadic", coalesce(x.v, '') params, coalesce(y.v, '') results from a left join w x on x.id = a.id and x.s = 'p' left join w y on y.id = a.id and y.s = 'r' left join p q on q.id = a.id and q.s = 'p'""")
def nested_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters and results of signatures with function types, maps, type arguments and channels."""
    s = Code(spark, sf_dir).sym
    sig = F.replace(F.replace(F.expr(_FORM.replace("p_partkey", "k")), F.lit("@"), F.col("name")), F.lit("#"), F.col("p_size").cast("string"))
    x = s.select("id", T.signature_parts(sig).alias("p"))
    return x.select("id", F.size("p.params").alias("n_params"), F.size("p.results").alias("n_results"), F.col("p.variadic").alias("variadic"), F.array_join("p.params", " | ").alias("params"), F.array_join("p.results", " | ").alias("results"))


# search

GLOBS = ["*.txt", "!src3/", "!src1?/fr/**", "!d*7.txt", "src1?/fr/d[0-4]*.txt"]
_PATH = "source || '/' || lang || '/d' || doc_id || case when lang = 'es' then '.md' else '.txt' end"
LINES = f"""ln as materialized (select path, i::int line, l[i] as text from (select {_PATH} path, string_split(text, chr(10)) l from documents), unnest(range(1, len(l) + 1)) x(i)),
sel as (select * from ln where case when regexp_matches(path, '^src1[^/]/fr/d[0-4][^/]*[.]txt$') then true when regexp_matches(path, '/d[^/]*7[.]txt$') or regexp_matches(path, '^src1[^/]/fr/') or regexp_matches(path, '^src3/') then false else ends_with(path, '.txt') end)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "es", ".md").otherwise(".txt"))
    return d.select(path.alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


HITS = "[A-Za-zé]*ti[ao][a-z]*"


@query(f"""with {LINES}, h as (select path, line, text, regexp_extract_all(text, '{HITS}') m, string_split_regex(text, '{HITS}') g from sel where regexp_matches(text, '{HITS}')),
k as (select path, line, text, m[i] as name, list_sum(list_transform(g[:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: strlen(x))), 0) + 1 c from h, unnest(range(1, len(m) + 1)) x(i))
select path, line, c::int col, (c + strlen(name))::int end_col, name, md5(trim(text)) as "match" from k""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13, C13: a row for each match on each line, with the bytes it spans, in the files that globs select."""
    return X.search(_lines(spark, sf_dir), HITS, GLOBS).withColumn("match", F.md5("match"))


@query(f"""with {LINES}, h as (select distinct path, line from sel where regexp_matches(text, '[Tt]ion[ao]')), n as (select path, line + o line, bool_or(o = 0) m from h, (values (-2), (-1), (0), (1), (2)) v(o) group by 1, 2), k as (select path, line, m, text from n join ln using (path, line)),
b as (select *, sum(case when line - p > 1 or p is null then 1 else 0 end) over (partition by path order by line) g from (select *, lag(line) over (partition by path order by line) p from k)) select path, min(line) over (partition by path, g) block, line, md5(text) as text, m is_match from b""")
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13, P51: matching lines with two lines before and after, those that touch in one block."""
    lines = _lines(spark, sf_dir)
    return X.with_context(lines, X.search(lines, "[Tt]ion[ao]", GLOBS), 2).withColumn("text", F.md5("text"))


# schemas

PATHS = ["migrations/02_b.sql", "migrations/01_a.SQL", "db/migrations/1.sql", "schema.sql", "db/schema.sql", "store/store.go", "store/store_test.go", "vendor/x/y.go", "main.go", "sql/migrations/0.sql", "cmd/run.go", "docs/schema.sql"]
TEXTS = [
    "create table a@ (x int);", "insert into a values ('@');", "CREATE  UNIQUE INDEX i@ on a(x)", "-- nothing of @", "// a ` stray quote of @\nconst q = `create view v@ as select 1`\n", 'var s = "create table no@ (`"\nvar t = `\nCREATE TRIGGER t@\n`',
    "/* `create table no@` */ x := '`'; y := `plain @` + `create index j@ on t(a)`; z := `create table open", "package m\n// create table comment@\n",
]
_TOKENS = r"""//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"(?:\\(?s:.)|[^"\\\n])*(?:["\n]|\\?\z)|''(?:\\(?s:.)|[^''\\\n])*(?:[''\n]|\\?\z)|`[^`]*(?:`|\z)"""
_TEXT = "(case p_size % 8 " + " ".join("when {} then '{}'".format(k, t.replace("'", "''").replace("\n", "' || chr(10) || '")) for k, t in enumerate(TEXTS)) + " end)"
_DDL = r"(?i)\bCREATE\s+(TABLE|INDEX|UNIQUE\s+INDEX|VIEW|TRIGGER)\b"


@query(f"""with f as materialized (select 'r' || (p_partkey // 12) root, ({PATHS!r})[(p_partkey % 12)::int + 1] path, replace({_TEXT}, '@', '' || p_partkey) t from part), k as (select * from f where not regexp_matches(path, '(^|/)vendor/')),
m as (select root, regexp_extract(path, '^(.*)/[^/]*$', 1) source, string_agg('-- ' || split_part(path, '/', -1) || chr(10) || t, chr(10) || chr(10) order by path) ddl from k where lower(path) like '%migrations/%' and lower(path) like '%.sql' group by 1, 2), m2 as (select * from m where regexp_matches(ddl, '{_DDL}') qualify row_number() over (partition by root order by list_position(['migrations', 'db/migrations', 'sql/migrations'], source)) = 1),
s as (select * from k where path in ('schema.sql', 'db/schema.sql') and regexp_matches(t, '{_DDL}') and root not in (select root from m2) qualify row_number() over (partition by root order by length(path)) = 1),
e as (select root, path, list_filter(list_transform(list_filter(regexp_extract_all(t, '{_TOKENS}'), lambda x: length(x) > 1 and starts_with(x, '`') and ends_with(x, '`')), lambda x: x[2:-2]), lambda x: regexp_matches(x, '{_DDL}')) p from k where ends_with(path, '.go') and not ends_with(path, '_test.go'))
select root, source, 'migrations' as name, md5(ddl) ddl from m2 union all select root, path, 'schema', md5(t) from s union all select root, path, case when contains(path, '/') then split_part(path, '/', -2) else '.' end, md5(array_to_string(p, chr(10) || chr(10))) from e where len(p) > 0""")
def schema_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18: schemas of many trees: migrations before a schema file, and raw strings of source files."""
    k, text = F.col("p_partkey"), F.element_at(F.array(*map(F.lit, TEXTS)), F.col("p_size") % 8 + 1)
    files = Tables(spark, sf_dir).part.select(F.concat(F.lit("r"), F.floor(k / 12).cast("string")).alias("root"), F.element_at(F.array(*map(F.lit, PATHS)), (k % 12 + 1).cast("int")).alias("path"), F.replace(text, F.lit("@"), k.cast("string")).alias("text"))
    return X.schemas(files).withColumn("ddl", F.md5("ddl"))


# concurrency

CODE = ["go run(x)", "ch <- v", "v := <-ch; go func() { out <- v }()", 's := "go no()" // <-no', "func f(c chan<- int, d <-chan int) {", "done <- struct{}{} /* go no() */; go  a.b(<-in)", "going := `<-no`", "x := 1"]
#: Columns of go statements and of arrows in each of these lines.
PLACES = [([1], []), ([], [4]), ([12], [6, 28]), ([], []), ([], []), ([35], [6, 43]), ([], []), ([], [])]
_PLACES = ", ".join(f"({k}, '{ctx}', {c})" for k, both in enumerate(PLACES) for ctx, at in zip(("go", "chan"), both, strict=True) for c in at)


@query(f"""with {SYM}, l as (select file_path, line_start + 2 line, max(p_size) p_size from sym group by 1, 2), x as (select file_path, line, ctx, c from l join (values {_PLACES}) v(t, ctx, c) on t = p_size % 8),
s as (select x.*, id, row_number() over (partition by x.file_path, x.line, ctx, c order by line_end - line_start, line_start, id) n from x join sym on sym.file_path = x.file_path and line between line_start and line_end and kind in ('func', 'method'))
select sha256(concat_ws(':', file_path, line, c, case ctx when 'go' then 'goref' else 'chanref' end)) id, id as symbol_id, file_path, line::int line, c::int col, id enclosing_id, ctx ast_ctx from s where n = 1""")
def synthetic_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC4: references for goroutines and channel operations, of the smallest function around them to itself."""
    s = Code(spark, sf_dir).sym
    text = F.element_at(F.array(*map(F.lit, CODE)), F.max("p_size") % 8 + 1)
    lines = s.groupBy(F.col("file_path").alias("path"), (F.col("line_start") + 2).alias("line")).agg(text.alias("text"))
    return X.concurrency_refs(lines, s).drop("snippet")


# conventions

SYM2 = """s2 as materialized (select case when kind = 'func' and p_size % 5 = 0 then 'New' || name when kind = 'var' and p_size % 3 = 0 then 'Err' || name when kind = 'interface' and p_size % 2 = 0 then name || 'er' else name end as name, kind, file_path, receiver,
 case when p_size % 10 = 5 then signature || ' error' else signature end signature from sym)"""


@query(f"""with {SYM}, {SYM2}, t as (select count(*) filter (kind = 'func' and starts_with(name, 'New') and ends_with(signature, 'error)')) c1, count(*) filter (kind = 'func' and starts_with(name, 'New') and not ends_with(signature, 'error)')) c2,
 count(*) filter (receiver is not null and kind = 'method' and length(regexp_replace(receiver, '[()*]', '', 'g')) = 1) r1, count(*) filter (receiver is not null and kind = 'method' and length(regexp_replace(receiver, '[()*]', '', 'g')) <> 1) r2, count(*) filter (kind = 'method' and contains(receiver, '*')) rp,
 count(*) filter (kind = 'interface' and regexp_matches(name, '^[A-Z]') and regexp_matches(lower(name), '[eo]r$')) i1, count(*) filter (kind = 'interface' and regexp_matches(name, '^[A-Z]') and not regexp_matches(lower(name), '[eo]r$')) i2, count(*) filter (kind = 'var' and starts_with(name, 'Err')) e1,
 count(*) filter (kind = 'func' and regexp_matches(signature, '(error[)]| error)$') and not ends_with(file_path, '_test.go')) e2, count(*) filter (kind = 'func' and ends_with(file_path, '_test.go') and regexp_matches(name, '^[a-z]')) h from s2),
f as (select file_path p, regexp_extract(file_path, '^(.*)/', 1) d, ends_with(file_path, '_test.go') t, count(*) filter (kind in ('struct', 'interface', 'type')) n from s2 group by 1), y as (select count(*) filter (t and d in (select d from f where not t)) t1, count(*) filter (t and d not in (select d from f where not t)) t2,
 count(*) filter (not t and n = 1) f1, count(*) filter (not t and n > 1) f2, sum(n) filter (not t) ft from f),
o as (select 'constructors' convention, case when c2 > c1 then '{C.NO_ERROR}' else '{C.ERROR}' end as pattern, greatest(c1, c2) / (c1 + c2) ratio, c1 a, c2 b, null::double measure from t union all select 'receivers', case when r2 > r1 then '{C.DESCRIPTIVE}' else '{C.SINGLE}' end, greatest(r1, r2) / (r1 + r2), r1, r2, round(1000 * rp / (r1 + r2)) / 10 from t
 union all select 'testing', case when t2 > t1 then '{C.SEPARATE}' else '{C.COLOCATED}' end, greatest(t1, t2) / (t1 + t2), t1, t2, h from t, y union all select 'interfaces', case when i2 > i1 then '{C.NOUN}' else '{C.SUFFIX}' end, greatest(i1, i2) / (i1 + i2), i1, i2, null from t
 union all select 'errors', case when e1 > e2 then '{C.SENTINEL}' when e1 > 0 then '{C.BOTH}' else '{C.INLINE}' end, greatest(e1, e2) / (e1 + e2), e1, e2, null from t
 union all select 'file_org', case when greatest(f1, f2) / (f1 + f2) < 0.7 or f1 = f2 then '{C.MIXED}' when f1 > f2 then '{C.ONE}' else '{C.MANY}' end, greatest(f1, f2) / (f1 + f2), f1, f2, round(10 * ft / (f1 + f2)) / 10 from y)
select convention, pattern, case when ratio >= 0.8 and a + b >= 3 then 'high' when ratio >= 0.6 and a + b >= 3 then 'medium' else 'low' end confidence, (a + b)::bigint total, a::bigint "first", b::bigint "second", measure from o where a + b > 0""")
def detected_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six conventions: constructors, receivers, tests, interfaces, errors, types in files."""
    s, size, kind, name = Code(spark, sf_dir).sym, F.col("p_size"), F.col("kind"), F.col("name")
    named = F.when((kind == "func") & (size % 5 == 0), F.concat(F.lit("New"), name)).when((kind == "var") & (size % 3 == 0), F.concat(F.lit("Err"), name)).when((kind == "interface") & (size % 2 == 0), F.concat(name, F.lit("er"))).otherwise(name)
    return C.detected(s.select(named.alias("name"), "kind", "file_path", "receiver", F.when(size % 10 == 5, F.concat("signature", F.lit(" error"))).otherwise(F.col("signature")).alias("signature")))


@query("""with e as (select distinct l_suppkey s, l_partkey d from lineitem where l_suppkey <> l_partkey), n as (select s node from e union select d from e), i as (select d node, count(*) c from e group by 1), o as (select s node, count(*) c from e group by 1)
select name, status, n_rows::bigint n_rows, error from (values ('broken', 'failed', null, true), ('of_broken', 'skipped', null, true), ('of_skipped', 'skipped', null, true)) v(name, status, n_rows, error) union all select 'in_degree', 'ok', count(*), false from n
 union all select 'out_degree', 'ok', count(*), false from n union all select 'busy', 'ok', count(*), false from (select 1 from n left join i using (node) left join o using (node) where coalesce(i.c, 0) > coalesce(o.c, 0))""")
def metric_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric steps that are written one by one; one fails, those that need it are passed, the others stand."""
    calls = R.counted_pairs(Tables(spark, sf_dir).lineitem, "l_suppkey", "l_partkey").filter("l_suppkey <> l_partkey")
    edges = calls.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    root, ranked = shared_folder(spark, "metrics"), lambda c: A.ranked_metric(G.degrees(edges).select("node", F.col(c).alias("value")), "calls", c)
    fails = lambda t: t["in_degree"].withColumn("value", F.raise_error(F.lit("no such metric")).cast("double"))
    pairs = lambda t: t["in_degree"].alias("i").join(t["out_degree"].alias("o"), "node_id").filter("i.value > o.value").select("node_id")
    steps = [("in_degree", lambda t: ranked("in_degree"), ()), ("broken", fails, ("in_degree",)), ("of_broken", fails, ("broken",)), ("of_skipped", fails, ("of_broken",)), ("out_degree", lambda t: ranked("out_degree"), ()), ("busy", pairs, ("in_degree", "out_degree"))]
    status, tables = C.run_steps(spark, root, steps), snapshots.snapshot(spark, root)
    counts = None
    for name in ("in_degree", "out_degree", "busy"):
        c = tables[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"))
        counts = c if counts is None else counts.unionByName(c)
    return status.join(counts, "name", "left").select("name", "status", "n_rows", F.col("error").isNotNull().alias("error"))
