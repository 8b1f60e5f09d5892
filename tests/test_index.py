"""Operators and commands on a hand-checked code index."""

import pytest

from codeloom.functions import exprs as E
from codeloom.operators import aggregates as A
from codeloom.operators import relations as R
from codeloom.plans.commands import Index
from codeloom.schemas import schema
from codeloom.sources import readers, sinks


def sym(i, name, kind="func", file="p/a.go", pkg="m/p", s=1, e=10, receiver=None, sig="func()", doc=""):
    return (i, name, kind, file, file, pkg, s, 1, e, 1, s, 6, sig, doc, receiver)


SYMBOLS = [
    sym("f1", "Save", s=1, e=10), sym("f2", "helper", s=12, e=20), sym("f3", "main", file="cmd/main.go", pkg="m/cmd", s=3, e=9), sym("t1", "TestSave", file="p/a_test.go", s=1, e=8),
    sym("i1", "Store", "interface", "p/store.go", s=1, e=4, sig=""), sym("s1", "Mem", "struct", "q/mem.go", "m/q", 1, 5, sig=""), sym("s2", "Half", "struct", "q/half.go", "m/q", 1, 5, sig=""),
    sym("m1", "Get", "method", "q/mem.go", "m/q", 7, 9, "(*Mem)"), sym("m2", "Put", "method", "q/mem.go", "m/q", 11, 13, "(Mem)"), sym("m3", "Get", "method", "q/half.go", "m/q", 7, 9, "(*Half)"),
    sym("d1", "Unused", file="p/b.go", s=1, e=3),
]
CALLS = [("f2", "f1", "p/a.go", 14, 2), ("f3", "f2", "cmd/main.go", 5, 2), ("t1", "f1", "p/a_test.go", 4, 2), ("f3", "m1", "cmd/main.go", 6, 2)]
REFS = [
    ("r1", "f1", "p/a.go", "p/a.go", 14, 2, "f2", "Save()", "call:Save"), ("r2", "f2", "cmd/main.go", "cmd/main.go", 5, 2, "f3", "helper()", None), ("r3", "f1", "p/a_test.go", "p/a_test.go", 4, 2, "t1", "Save()", None),
    ("r4", "i1", "q/mem.go", "q/mem.go", 2, 3, "m1", "Store", "sig"), ("r5", "i1", "cmd/main.go", "cmd/main.go", 7, 3, "f3", "Store", "lit"), ("r6", "gone", "p/a.go", "p/a.go", 15, 2, "f2", "x", None), ("r7", "f1", "p/a.go", "p/a.go", 16, 2, "nope", "x", ""),
]
IMPORTS = [("cmd/main.go", "m/p", None, 3, 1, "m/cmd"), ("cmd/main.go", "m/q", None, 4, 1, "m/cmd"), ("q/mem.go", "m/p", None, 3, 1, "m/q"), ("q/mem.go", "database/sql", None, 4, 1, "m/q")]


@pytest.fixture(scope="module")
def index(spark):
    make = lambda rows, t: spark.createDataFrame(rows, schema(t))
    literals = [("l1", "DB_URL", None, "env", "p/a.go", "p/a.go", 3, 1, "f1", ""), ("l2", "MY_DB_URL", None, "env", "q/mem.go", "q/mem.go", 8, 1, "m1", "")]
    return Index(spark, {"symbols": make(SYMBOLS, "symbols"), "call_graph": make(CALLS, "call_graph"), "refs": make(REFS, "refs"), "imports": make(IMPORTS, "imports"), "string_refs": make(literals, "string_refs")})


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_lookup_falls_back_in_order(index):
    got = {(r.query, r.id, r.tier) for r in index.definition(["Save", "SAVE", "elp", "nothing"]).collect()}
    assert got == {("Save", "f1", 1), ("SAVE", "f1", 2), ("elp", "f2", 3)}


def test_position_resolution(index, spark):
    points = [("exact name", "p/a.go", 1, 6), ("exact ref", "p/a.go", 14, 2), ("near name", "p/a.go", 12, 40), ("enclosing", "p/a.go", 5, 1), ("near ref", "p/a.go", 14, 9)]
    got = {r.point_id: (r.symbol_id, r.tier) for r in index.at(spark.createDataFrame(points, "point_id string, file_path string, line int, col int")).collect()}
    assert got == {"exact name": ("f1", 1), "exact ref": ("f1", 2), "near name": ("f2", 3), "enclosing": ("f1", 6), "near ref": ("f1", 4)}


def test_hops_tests_and_impact(index):
    hops = {(r.node, r.hop) for r in R.two_hops(index.call_graph, index._ids(["f1"], "seed"), "caller_id", "callee_id").collect()}
    assert hops == {("f2", 1), ("t1", 1), ("f3", 2)}
    assert ids(index.tests_of(["f1"]), "node") == ["t1"]
    got = {r.node: (r.first_phase, r.hints) for r in index.impact(["f1"]).collect()}
    assert got["t1"] == (0, ["caller", "test"]) and got["f3"] == (1, ["transitive"]) and got["f2"][1] == ["caller", "reference"]


def test_division(index, spark):
    need = spark.createDataFrame([("i1", "Get"), ("i1", "Put"), ("i2", "Get")], "interface_id string, name string")
    got = {(r.interface_id, r.type_id) for r in index.implementers_of(need).collect()}
    assert got == {("i1", "s1"), ("i2", "s1"), ("i2", "s2")}
    assert ids(R.cooccurring_types(index.symbols, index.refs, "i1")) == ["s1"]
    assert [(r.interface_id, r.score) for r in index.seams(need).collect()] == [("i1", 5)]


def test_ranges_and_overlap(index, spark):
    r = spark.createDataFrame([("f", 5, 8), ("f", 9, 12), ("f", 20, 18), ("f", 30, 40), ("f", 31, 33), ("g", 1, 1)], "path string, line_start int, line_end int")
    got = {(x.path, x.start, x.end, x.n_ranges) for x in R.merged_ranges(r, ["path"], "line_start", "line_end").collect()}
    assert got == {("f", 5, 12, 2), ("f", 18, 20, 1), ("f", 30, 40, 2), ("g", 1, 1, 1)}
    changes = spark.createDataFrame([("p/a.go", 10, 11), ("p/a.go", 3, 3)], "path string, line_start int, line_end int")
    stale = spark.createDataFrame([("q/half.go",)], "path string")
    assert ids(index.touched(changes, stale)) == ["f1", "m3", "s2"]
    v = {x.id: (x.covered, x.n_outside) for x in index.verify(changes).collect()}
    assert v == {"f1": (True, 1)}
    got = index.risk(changes).first()
    assert got.score > 0 and got.difficulty is None and got.safety_net is not None and got.degraded is None
    none = index.risk(changes.limit(0)).first()
    assert none.score is None and none.degraded == "no changed symbols"


def test_dead_exports(index):
    assert ids(index.dead()) == ["d1", "m1", "m2", "m3", "s1", "s2"]


def test_write_filters_and_incremental(index, spark):
    kept = sinks.known_refs(index.refs, index.symbols)
    assert ids(kept) == ["r1", "r2", "r3", "r4", "r5"]
    assert sinks.orphan_count(index.refs, index.symbols).first().n_orphans == 1
    new = index.symbols.filter("id = 'f1'").withColumn("file_path", E.F.lit("p/new.go"))
    gone = spark.createDataFrame([("p/a.go",)], "path string")
    assert ids(sinks.replace_files(index.symbols, new, gone)) == sorted({s[0] for s in SYMBOLS} - {"f2"})
    assert sinks.upsert(index.symbols, new, ["id"]).filter("id = 'f1'").first().file_path == "p/new.go"
    rows = spark.createDataFrame([("a", "header", 1), ("a", "loader", 2), ("b", "header", 3)], "f string, source string, v int")
    assert {(r.f, r.v) for r in sinks.by_precedence(rows, ["f"], "source", ["loader", "header"]).collect()} == {("a", 2), ("b", 3)}
    h = [sinks.bundle_hash(spark.createDataFrame(x, "path string, hash string")).first().bundle for x in ([("a", "1"), ("b", "2")], [("b", "2"), ("a", "1")], [("a", "2"), ("b", "1")])]
    assert h[0] == h[1] != h[2]


def test_commands(index, spark):
    assert {(r.a, r.b, r.weight) for r in index.system_map("m").collect()} == {("cmd", "p", 1), ("cmd", "q", 1), ("q", "p", 1)}
    assert {(r.importer_pkg, r.pkg_path, r.n_units) for r in index.dependencies("m").collect()} == {("m/cmd", "m/p", 1), ("m/cmd", "m/q", 1), ("m/q", "m/p", 1)}
    assert [(r.technology, r.importers) for r in index.datastores([("database/sql", "SQL")]).collect()] == [("SQL", ["m/q"])]
    assert sorted(r.system for r in index.external_systems().collect()) == ["db", "my_db"]
    assert [r.value for r in index.trace("DB_URL").collect()] == ["DB_URL"] and [r.value for r in index.trace("MY").collect()] == ["MY_DB_URL"]
    roles = {r.id: r.role for r in index.roles().collect()}
    assert roles == {"f1": "internal", "f2": "entry_point", "f3": "internal", "t1": "internal", "m1": "entry_point", "m2": "internal", "m3": "internal", "d1": "internal"}  # main is one in a package of that name
    assert ids(index.callers_of(["f1"]), "caller_id") == ["f2", "t1"] and ids(index.importers("m/p"), "importer_pkg") == ["m/cmd", "m/q"]
    assert ids(index.type_members("Mem")) == ["m1", "m2"]
    assert {r.fn: r.role for r in index.lifecycle("Store").collect()} == {"Get": "read", "main": "create"}
    lines = spark.createDataFrame([("p/a.go", 5, "x := Save()"), ("p/a.go", 11, "gap Save")], "file_path string, line_no int, line string")
    assert {(r.line, r.name) for r in index.search(lines, "Save").collect()} == {(5, "Save"), (11, "helper")}
    assert {r.name for r in index.search(lines, "Unus").collect()} == {"Unused"}
    assert index.context().count() > 0 and index.change_plan(["f1"], 1).count() == 2


def test_diff_and_log_sources(spark):
    text = ["diff", "--- a/x.go", "+++ b/x.go", "@@ -1,2 +3,4 @@", "+a", "@@ -9 +12 @@", "@@ -20,3 +25,0 @@", "+++ /dev/null", "@@ -1 +1 @@"]
    diff = spark.createDataFrame([(1, n, x) for n, x in enumerate(text)], "diff_id int, n int, line string")
    assert sorted(tuple(r) for r in readers.diff_ranges(diff).collect()) == [("x.go", 3, 6), ("x.go", 12, 12)]
    log = ["@c1|ann|2024-01-02 00:00:00|bug,chore", "a.go", "", "b.go", "@c2|bob|2024-01-03 00:00:00|", "a.go"]
    commits = readers.commit_files(spark.createDataFrame([(1, n, x) for n, x in enumerate(log)], "log_id int, n int, line string"))
    churn = {r.path: (r.commits, r.authors, r.bug_commits, r.untyped_commits, round(r.score, 6)) for r in A.churn(commits.withColumn("kind", E.commit_type(E.F.col("types"))), "path", "at", "author", "kind", 1.0, ["bug", "untyped"]).collect()}
    assert churn == {"a.go": (2, 2, 1, 1, 1.5), "b.go": (1, 1, 1, 0, 0.5)}
    num = spark.createDataFrame([("3", "1", "a.go"), ("-", "-", "x.png"), ("5", "5", "a_test.go")], "added string, deleted string, path string")
    assert tuple(readers.changed_lines(num).first()) == (3, 1)


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.go").write_text("// Package a does\n// things.\npackage a\nvar X = 1")
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "v.go").write_text("x")
    r = readers.file_snapshot(spark, str(tmp_path)).collect()
    assert [(x.lines, x.header) for x in r] == [(4, "Package a does things.")]
    lines = spark.createDataFrame([("f", 1, 'x := os.Getenv("A_KEY")'), ("f", 2, 'const Name = "v"'), ("f", 3, 'open("testdata/x.json")'), ("f", 4, "none")], "path string, line_no int, line string")
    assert [(x.kind, x.value) for x in readers.literals(lines).orderBy("line_no").collect()] == [("env", "A_KEY"), ("const", "v"), ("fixture", "testdata/x.json")]
    (tmp_path / "log.json").write_text('{"ts":"2024-01-01T00:00:00Z","cmd":"def","outcome":"ok","ms":5}\nnot json\n{"cmd":"def","outcome":"error","ms":9}\n')
    rep = A.usage_report(readers.event_log(spark, str(tmp_path / "log.json"))).first()
    assert (rep.calls, rep.errors, rep.p50_ms) == (2, 1, 9)
    ddl = spark.createDataFrame([("m.sql", "CREATE TABLE IF NOT EXISTS users (id int); create table `orders` (x int)")], "path string, text string")
    assert sorted(x.name for x in readers.ddl_statements(ddl).collect()) == ["orders", "users"]
    more = spark.createDataFrame([("m.sql", "create UNIQUE  index i1 on t(x); CREATE VIEW v as select 1; create trigger if not exists t1; recreate table no")], "path string, text string")
    assert sorted((x.kind, x.name) for x in readers.ddl_statements(more).collect()) == [("trigger", "t1"), ("unique index", "i1"), ("view", "v")]


def test_expressions(spark):
    F = E.F
    row = spark.createDataFrame([("pkg/x.go:12:3", "func F(a int, b ...Opt) (Result, error)", "parseHTTPRequest", "First one. Second.", "running", "(*T)")], "pos string, sig string, name string, doc string, w string, recv string")
    got = row.select(
        E.parse_position(F.col("pos")).alias("p"), E.flat_parameters(F.col("sig")).alias("params"), E.is_variadic(F.col("sig")).alias("v"), E.related_types(F.col("sig")).alias("t"), E.camel_words(F.col("name")).alias("c"),
        E.first_sentence(F.col("doc")).alias("s"), E.stem(F.col("w")).alias("stem"), E.receiver_type(F.col("recv")).alias("r"), E.layer_of(F.lit("m/internal/store/x"), "m").alias("l"), E.action_verb(F.lit("LoadAll")).alias("verb"),
        E.mean_of_present(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.25)).alias("m"), E.truncated(F.lit("abcdef"), 3).alias("tr"),
    ).first()
    assert tuple(got.p) == ("pkg/x.go", 12, 3) and got.params == ["a int", "b ...Opt"] and got.v and got.t == ["F", "Opt", "Result"]
    assert (got.c, got.s, got.stem, got.r, got.l, got.verb, got.m, got.tr) == ("parse http request", "First one.", "runn", "T", "internal/store", "loads", 0.375, "abc...")
