"""Queries that list, emit and replace: members of types, filtered references, texts, tables replaced whole; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.lineage import shared_folder
from codeloom.literals import literal_rows
from codeloom.operators import listings as M
from codeloom.plans.indexed import IMP, SYM, Code
from codeloom.plans.registry import Tables, query
from codeloom.plans.rules import RL, RR, RS, Rules
from codeloom.sources import readers, sinks, snapshots

_MEMBERS = f"""{SYM}, ty as (select id, name t, file_path, line_start, line_end from sym where kind = 'struct'), m as (select ty.id type_id, 'method' member, s.name, s.line_start line from ty join sym s on s.kind = 'method' and regexp_extract(receiver, '([A-Z][0-9]+)', 1) = t
 union all select ty.id, 'field', s.name, s.line_start from ty join sym s on s.kind = 'field' and s.file_path = ty.file_path and s.line_start between ty.line_start and ty.line_end
 union all select ty.id, 'embed', e.name, r.line from (select 's' || l_partkey symbol_id, f.file_path, (f.line_start + l_linenumber)::int line, l_linenumber n from lineitem join sym f on f.k = l_suppkey) r join sym e on e.id = r.symbol_id and e.kind in ('struct', 'interface') and n % 3 < 2 join ty on ty.file_path = r.file_path and r.line between ty.line_start and ty.line_end)"""


def _types(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = Code(spark, sf_dir)
    own = c.sym.select(F.col("k").alias("l_suppkey"), "file_path", "line_start")
    types = c.sym.filter(F.col("kind").isin("struct", "type", "interface"))  # no other is embedded
    target = types.select(F.col("k").alias("l_partkey"), F.col("id").alias("symbol_id"), F.col("name").alias("_n"))
    n = F.col("l_linenumber") % 3
    snippet = F.when(n == 0, F.concat(F.lit("*pkg."), "_n")).when(n == 1, F.concat("_n", F.lit(" //x"))).otherwise(F.concat(F.lit("f "), "_n"))
    refs = c.t.lineitem.select("l_partkey", "l_suppkey", "l_linenumber").join(target.hint("shuffle_hash"), "l_partkey").join(own.hint("shuffle_hash"), "l_suppkey").select("symbol_id", "file_path", (F.col("line_start") + F.col("l_linenumber")).cast("int").alias("line"), snippet.alias("snippet"))
    return c.sym, refs


@query(f"with {_MEMBERS} select type_id, member, name, line::int line from m")
def type_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods, fields and embedded types of each type."""
    return M.type_members(*_types(spark, sf_dir))


@query(f"with {_MEMBERS} select type_id, count(*)::bigint richness from (select distinct type_id, member, name from m) group by 1")
def type_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many methods, fields and embedded types each type has."""
    return M.type_richness(*_types(spark, sf_dir))


FILTERS = [("all", "DeleteRow", None, None, None), ("kind", "NewStore", "func", None, None), ("file", "T1Reader", None, "/f2.go", None), ("package", "Query", None, None, "app/brand1"), ("every", "T0", "struct", ".go", "app/brand2"), ("none", "no such", None, None, None)]


@query(f"""with {RS}, {RL}, {RR}, q(query, n, kd, fl, pk) as (values {", ".join("(" + ", ".join("null" if v is None else f"'{v}'" for v in f) + ")" for f in FILTERS)})
select query, rr.id from rr join rs t on t.id = symbol_id join q on q.n = t.name left join rs e on e.id = enclosing_id where (kd is null or t.kind = kd) and (fl is null or contains(rr.file_path, fl)) and (pk is null or e.pkg_path = pk or starts_with(e.pkg_path, pk || '/'))""")
def filtered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by name, and by kind, file and package where these are given."""
    r = Rules(spark, sf_dir)
    return M.filtered_references(r.refs, r.symbols, literal_rows(spark, FILTERS, "query string, name string, kind string, file string, package string"))


@query(f"""with {SYM} select id, '- id: "' || id || '"' || chr(10) || '  name: "' || name || '"' || chr(10) || '  line_start: ' || line_start || case when doc is null then '' else chr(10) || '  doc: "' || doc || '"' end as "yaml", id || chr(9) || name || chr(9) || line_start || chr(9) || coalesce(doc, '') as "text" from sym""")
def emitted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK15: rows as items of YAML and as lines of text."""
    s = Code(spark, sf_dir).sym.select("id", "name", "line_start", "doc")
    key = lambda df, column, pattern: df.select(F.regexp_extract(column, pattern, 1).alias("id"), column)
    return key(sinks.as_yaml(s), "yaml", '^- id: "([^"]*)"').join(key(sinks.as_text(s), "text", "^([^\t]*)\t"), "id")


@query("""select 'imports' "table", l_suppkey::varchar a, l_partkey::varchar b, null::double score from (select distinct l_suppkey, l_partkey from lineitem where l_linestatus = 'O') union all select 'churn', user_id::varchar, event_type, round(sum(value), 6) from events where event_type <> 'click' group by 2, 3
union all select 'symbols', p_partkey::varchar, p_name, null from part""")
def replaced_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5, SK12: imports and churn replaced whole, each by a commit of its own; what is not replaced stays."""
    t, root = Tables(spark, sf_dir), shared_folder(spark, "replaced")
    text = lambda c, name: F.col(c).cast("string").alias(name)
    imports = lambda rows: rows.select(text("l_suppkey", "a"), text("l_partkey", "b")).distinct()
    churn = lambda rows: rows.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("score")).select(text("user_id", "a"), F.col("event_type").alias("b"), "score")
    snapshots.commit(spark, root, {"symbols": t.part.select(text("p_partkey", "a"), F.col("p_name").alias("b")), "imports": imports(t.lineitem), "churn": churn(t.events)})
    snapshots.commit(spark, root, {"imports": imports(t.lineitem.filter("l_linestatus = 'O'"))})
    snapshots.commit(spark, root, {"churn": churn(t.events.filter("event_type <> 'click'"))})
    found = snapshots.snapshot(spark, root)
    none = F.lit(None).cast("double").alias("score")
    rows = [x.select(F.lit(n).alias("table"), "a", "b", "score" if n == "churn" else none) for n, x in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


MANIFEST = """# of @
version: 1
rules:
  - name: "inner @"   # quoted
    from: mod/internal/brand@
    to: 'mod/brand@'
    kinds: [call, "ref"]
    allow:
      - _gen.go
      - "_mock.go"
  - from: mod/brand@
    name: one way @
    to: mod/brand1
    include_tests: true
  - name: no end
    from: x
other:
  - name: none
    from: a
    to: b
"""


@query(f"""with {SYM}, {IMP}, r(name, f, t, kinds, allow, tests, place) as (select 'inner ' || n_nationkey, 'mod/internal/brand' || n_nationkey, 'mod/brand' || n_nationkey, 'call,ref', '_gen.go,_mock.go', false, 1 from nation union all select 'one way ' || n_nationkey, 'mod/brand' || n_nationkey, 'mod/brand1', '', '', true, 2 from nation),
e as (select distinct importer_pkg, pkg_path from imp) select name "rule", place::int place, kinds, allow, tests include_tests, count(e.pkg_path)::bigint n_edges from r left join e on importer_pkg = f and pkg_path = t group by all""")
def manifest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20, C17: the rules that manifests hold, each with the imports that it forbids."""
    c = Code(spark, sf_dir)
    files = c.t.nation.select(F.col("n_nationkey").cast("string").alias("path"), F.replace(F.lit(MANIFEST), F.lit("@"), F.col("n_nationkey").cast("string")).alias("text"))
    edges = c.imp.select(F.col("importer_pkg").alias("from_grp"), F.col("pkg_path").alias("to_grp")).distinct().withColumn("hit", F.lit(1))
    x = readers.manifest_rules(files).join(edges, ["from_grp", "to_grp"], "left")
    joined = [F.array_join(n, ",").alias(n) for n in ("kinds", "allow")]
    return x.groupBy("rule", "place", *joined, "include_tests").agg(F.count("hit").alias("n_edges"))
