"""Queries that resolve typed names and build maps on the index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import exprs as E
from codeloom.operators import classify as K
from codeloom.operators import relations as R
from codeloom.operators import resolve as V
from codeloom.plans.indexed import CG, IMP, SYM, Code
from codeloom.plans.registry import Tables, query
from codeloom.plans.rules import RC, RL, RR, RS, Rules


@query(f"""with {SYM}, {IMP}, k as (select pkg_path p from imp union select importer_pkg from imp), q as (select distinct regexp_replace(pkg_path, '^mod/', '') query from sym where p_size % 2 = 0 union select pkg_path from sym union select 'x' || id from sym)
select query, case when query in (select p from k) then query when 'mod/' || query in (select p from k) then 'mod/' || query else query end pkg_path from q""")
def full_import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import paths as they are typed to those that the imports know."""
    c = Code(spark, sf_dir)
    p = F.col("pkg_path")
    asked = c.sym.filter("p_size % 2 = 0").select(F.regexp_replace(p, "^mod/", "").alias("query")).unionByName(c.sym.select(p.alias("query"))).unionByName(c.sym.select(F.concat(F.lit("x"), "id").alias("query")))
    return V.full_paths(asked, c.imp, "mod")


@query(f"""with {SYM}, p as (select distinct pkg_path p from sym), q as (select id, case p_size % 5 when 0 then 'main' when 1 then '.' when 2 then split_part(pkg_path, '/', -1) when 3 then pkg_path else 'no' || name end query, case when p_size % 2 = 0 then name end folder from sym), r as (select p root from p order by length(p), p limit 1),
e as (select query, p, row_number() over (partition by query order by length(p), p) n from (select distinct query from q where not contains(query, '/') and not contains(query, '.')) join p on ends_with(p, '/' || query))
select id, q.query, case when q.query = 'main' then root when q.query = '.' then root || coalesce('/' || nullif(folder, ''), '') else coalesce(e.p, q.query) end pkg_path from q left join e on e.query = q.query and n = 1, r""")
def named_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main, the present folder and short names to packages."""
    s = Code(spark, sf_dir).sym
    size = F.col("p_size") % 5
    q = F.when(size == 0, "main").when(size == 1, ".").when(size == 2, E.short_package(F.col("pkg_path"))).when(size == 3, F.col("pkg_path")).otherwise(F.concat(F.lit("no"), "name"))
    asked = s.select("id", q.alias("query"), F.when(F.col("p_size") % 2 == 0, F.col("name")).alias("folder"))
    return V.packages_named(asked, s, F.col("folder")).select("id", "query", "pkg_path")


WORK = ["go 1.22\nuse ./a@\n", "use (\n\t./x@ // the first\n\t\"./y z\"\n\t// ./not\n)\nuse ./b", "go 1.22\n// use ./no\n", "use(./c@)\nreplace x => ../use ./d\n"]
USED = [["./a@/..."], ["./x@/...", "./y z/...", "./b/..."], ["./..."], ["./c@/..."]]


@query("with p as (select p_partkey k, case when p_size % 5 < 4 then " + str(USED) + "[p_size % 5 + 1] else ['./...'] end u from part) select k root, replace(x, '@', '' || k) pattern from (select k, unnest(u) x from p)")
def workspace_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10: what to load of each tree, by its workspace file."""
    text = F.when(F.col("p_size") % 5 < 4, F.replace(F.element_at(F.array(*map(F.lit, WORK)), F.least(F.col("p_size") % 5, F.lit(3)) + 1), F.lit("@"), F.col("p_partkey").cast("string")))
    return V.workspace_patterns(Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("root"), text.alias("text")))


@query(f"""with {SYM}, {IMP}, d as (select case when contains(pkg_path, '1') then 'SQL' when contains(pkg_path, '2') then 'Bolt' else 'Rings' end t, importer_pkg || case when contains(importer_pkg, '7') then '_test' else '' end p from imp where contains(pkg_path, '1') or contains(pkg_path, '2') or contains(pkg_path, '5'))
select p pkg_path, arg_min(t, (t = 'SQL', t)) technology from d where not ends_with(p, '_test') group by 1""")
def datastore_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One technology for each package that opens a datastore, test packages left out."""
    i = Code(spark, sf_dir).imp
    p = F.col("pkg_path")
    tech = F.when(p.contains("1"), "SQL").when(p.contains("2"), "Bolt").when(p.contains("5"), "Rings")
    named = F.concat("importer_pkg", F.when(F.col("importer_pkg").contains("7"), "_test").otherwise(""))
    stores = i.select(tech.alias("technology"), named.alias("who")).filter("technology is not null").groupBy("technology").agg(F.collect_set("who").alias("importers"))
    return V.datastore_rows(stores)


@query(f"""with {SYM}, {CG}, l as (select 'l' || k id, p_name v, 's' || k enc from (select p_partkey k, p_name from part)), q(query) as (values ('red widget'), ('small'), ('none such'), ('old ')), e as (select query, id, enc, 1 tier from l join q on v = query), n as (select query, id, enc, 2 tier from l join q on contains(v, query) where query not in (select query from e)),
c as (select callee_id id, list_sort(list(distinct s.name))[1:5] l from cg join sym s on s.id = caller_id group by 1) select query, x.id, tier::int tier, s.name enclosing_name, array_to_string(l, ',') callers from (select * from e union all select * from n) x left join sym s on s.id = enc left join c on c.id = enc""")
def traced_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals by value, else by part of it, with the symbol around them and its first five callers."""
    c = Code(spark, sf_dir)
    k = F.col("p_partkey").cast("string")
    literals = c.t.part.select(F.concat(F.lit("l"), k).alias("id"), F.col("p_name").alias("value"), F.concat(F.lit("s"), k).alias("enclosing_id"))
    x = V.traced(c.listed(["red widget", "small", "none such", "old "], "query string"), literals, c.sym, c.cg)
    return x.withColumn("callers", F.array_join("callers", ","))


@query(f"""with recursive {RS}, {RL}, {RR}, ty as (select id, name from rs where kind in ('struct', 'interface')), x as (select rr.id ref_id, symbol_id, ty.name t, nullif(enclosing_id, '') enc, rr.file_path, line, coalesce(ast_ctx, '') c, snippet from rr join ty on ty.id = symbol_id),
u as (select *, ends_with(file_path, '_test.go') or ends_with(file_path, '_gen.go') or contains(file_path, '/zz_generated_') test, c in ('lit', 'new', 'make') made, starts_with(c, 'call:') and (c = 'call:delete' or regexp_matches(c, '^call:(Delete|Remove|Drop|Purge)([A-Z]|$)') or c in ('call:Exec', 'call:ExecContext') and upper(snippet) like '%DELETE%') gone from x),
g as (select symbol_id, t, enc, bool_or(gone) gone, bool_or(made) made, arg_min(test, (file_path, line, ref_id)) test from u where enc is not null group by 1, 2, 3), h as (select g.*, f.name fn, coalesce(f.signature, '') sig from g left join rs f on f.id = enc),
l as (select symbol_id, fn, test, case when gone then 'delete' when made then 'create' when regexp_matches(fn, '^(New|Make|Build|Create)([A-Z]|$)') and regexp_matches(sig, '[)]\\s*([(]\\s*)?[*]?\\b' || t || '\\b') then 'create' when regexp_matches(fn, '^(Delete|Remove|Archive|Drop|Purge)([A-Z]|$)') then 'delete'
 when regexp_matches(fn, '^(Set|Update|Add|Append|Put|Upsert|Merge)([A-Z]|$)') and regexp_matches(sig, '[*]\\s*\\b' || t || '\\b') then 'mutate' else 'read' end r from h union all select symbol_id, null, test, case when made then 'create' else 'type-use' end from u where enc is null),
k as (select symbol_id, case when test then 'Tests' else r end grp, coalesce(fn, '(file-scope)') n from l) select symbol_id, grp, count(*)::bigint "count", array_to_string(list_sort(list(distinct n)), ',') names, list_position(['create', 'read', 'mutate', 'delete', 'type-use', 'Tests'], grp)::int place from k group by 1, 2""")
def lifecycle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type's functions by what they do with it, tests apart."""
    r = Rules(spark, sf_dir)
    types = r.symbols.filter(F.col("kind").isin("struct", "interface")).select(F.col("id").alias("symbol_id"), F.col("name").alias("type_name"))
    x = V.lifecycle_groups(K.type_lifecycles(r.refs, r.symbols, types), r.symbols)
    return x.withColumn("names", F.array_join("names", ","))


@query(f"""with {RS}, {RL}, {RC}, p as (select *, case when name = 'main' then 1 when name = 'Execute' then 2 when regexp_matches(name, '^run[A-Z]') and contains(file_path, '/cmd/') then 3 end p from rs where kind in ('func', 'method') and not ends_with(file_path, '_test.go')),
d as (select distinct caller_id id, case when o.receiver is not null then 'T.' || o.name else o.name end name from rc join rs o on o.id = callee_id), w as (select *, 5 - case when regexp_extract(name, '([^.]*)$', 1) in ('DB', 'Close', 'String', 'Error', 'Err', 'Bytes', 'Len', 'Reset') then 4 else 0 end + case when contains(name, '.') then 3 else 0 end
 + case when regexp_matches(name, '(^|[.])[A-Z][^.]*$') then 2 else 0 end - case when regexp_matches(lower(name), '(^|[.])(is|has)[^.]*$') then 2 else 0 end s from d), t as (select id, list(name order by s desc, name)[1:5] l from w group by 1)
select p.id, name, p::int priority, case when p_size % 4 = 0 then 'Does ' || name end doc, coalesce(array_to_string(l, ','), '') callees from p left join t using (id) where p is not null""")
def entry_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points with their doc and the five callees that tell most."""
    r = Rules(spark, sf_dir)
    s = r.symbols.withColumn("doc", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Does "), "name")))
    return V.entry_details(s, r.calls).withColumn("callees", F.array_join("callees", ","))


@query(f"""with {SYM}, own as (select id, name, pkg_path, 'T' || (k % 7) t from sym where kind = 'interface'), have as (select distinct regexp_extract(receiver, '([A-Z][0-9]+)', 1) t, pkg_path, name from sym where kind = 'method'), need as (select distinct own.id, h.name from own join have h on h.t = own.t and h.pkg_path = own.pkg_path),
n as (select id, count(*) n from need group by 1), cov as (select need.id, h.t, h.pkg_path from need join have h on h.name = need.name group by all having count(*) = any_value((select n from n where n.id = need.id))), impl as (select cov.id, count(distinct s.id) c from cov join sym s on s.kind = 'struct' and s.name = cov.t and s.pkg_path = cov.pkg_path group by 1)
select own.id interface_id, name, n::bigint n_methods, c::bigint n_impl from own join impl using (id) join n using (id) where n >= 2 or c >= 2 order by name, interface_id limit 15""")
def interface_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces that several types hold, or that ask for several methods."""
    c = Code(spark, sf_dir)
    methods = c.sym.filter("kind = 'method'").select(E.receiver_type(F.col("receiver")).alias("_t"), "pkg_path", "name").distinct()
    faces = c.sym.filter("kind = 'interface'")
    needed = faces.select(F.col("id").alias("interface_id"), "pkg_path", F.concat(F.lit("T"), (F.col("k") % 7).cast("string")).alias("_t")).join(methods, ["_t", "pkg_path"]).select("interface_id", "name")
    return V.interface_map_of_counts(faces, needed, R.implementer_counts(c.sym, needed))


@query("""with r as (select event_type metric, user_id run, sum(value) v from events group by 1, 2), m as (select metric, count(*) n, avg(v) mean from r group by 1) select metric, n::bigint n_runs, round(mean, 6) mean, round(100 * mean / sum(mean) over (), 6) share from m""")
def baseline_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each metric over its runs, and its share of all."""
    x = V.baseline(Tables(spark, sf_dir).events.select(F.col("event_type").alias("metric"), F.col("user_id").alias("run"), "value"))
    return x.withColumns({c: F.round(c, 6) for c in ("mean", "share")})
