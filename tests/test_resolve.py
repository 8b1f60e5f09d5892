"""Typed names, workspaces, traces, maps, members and emitted texts on small tables with their edges."""

import json

from pyspark.sql import functions as F

from codeloom.operators import listings as M
from codeloom.operators import resolve as V
from codeloom.sources import sinks

SYMBOLS = "id string, name string, kind string, signature string, pkg_path string, file_path string, receiver string, line_start int, line_end int, doc string"


def symbols(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (10 - len(r))) for r in rows], SYMBOLS)


def test_full_paths(spark):
    imports = spark.createDataFrame([("m/a", "m/b"), ("fmt", "m/b"), (None, "a")], "pkg_path string, importer_pkg string")
    asked = spark.createDataFrame([("a",), ("b",), ("fmt",), ("m/a",), ("zz",), ("a",)], "query string")
    assert {tuple(r) for r in V.full_paths(asked, imports, "m").collect()} == {("a", "a"), ("b", "m/b"), ("fmt", "fmt"), ("m/a", "m/a"), ("zz", "zz")}


def test_packages_named(spark):
    s = symbols(spark, [("1", "x", "func", "", p) for p in ("m", "m/internal/store", "m/vendor/x/store", "m/b", None)])
    asked = spark.createDataFrame([("main", ""), (".", ""), (".", "b"), (".", None), ("store", ""), ("none", ""), ("x/store", ""), ("a.b", "")], "query string, folder string")
    got = {(r["query"], r.folder): r.pkg_path for r in V.packages_named(asked, s, F.col("folder")).collect()}
    assert got == {("main", ""): "m", (".", ""): "m", (".", "b"): "m/b", (".", None): "m", ("store", ""): "m/internal/store", ("none", ""): "none", ("x/store", ""): "x/store", ("a.b", ""): "a.b"}


def test_workspaces(spark):
    texts = {"block": 'go 1.22\nuse (\n\t./a // first\n\t"./b c"\n)\n', "alone": "use ./x\nuse ./y", "none": "go 1.22\n// use ./z", "missing": None, "empty": "use (\n)\n", "words": "reuse ./q\nuser ./r"}
    got = {}
    for r in V.workspace_patterns(spark.createDataFrame(list(texts.items()), "root string, text string")).collect():
        got.setdefault(r.root, set()).add(r.pattern)
    every = {"./..."}
    assert got == {"block": {"./a/...", "./b c/..."}, "alone": {"./x/...", "./y/..."}, "none": every, "missing": every, "empty": every, "words": every}


def test_datastores_and_baselines(spark):
    stores = spark.createDataFrame([("SQL", ["a", "b", "c_test"]), ("Lite", ["a"]), ("Bolt", ["a", "d"])], "technology string, importers array<string>")
    assert {tuple(r) for r in V.datastore_rows(stores).collect()} == {("a", "Bolt"), ("b", "SQL"), ("d", "Bolt")}
    runs = spark.createDataFrame([("load", 1, 2.0), ("load", 1, 2.0), ("load", 2, 8.0), ("scan", 1, 2.0), ("scan", 2, None)], "metric string, run int, value double")
    assert {tuple(r) for r in V.baseline(runs).collect()} == {("load", 2, 6.0, 75.0), ("scan", 1, 2.0, 25.0)}
    assert V.baseline(runs.limit(0)).collect() == []


def test_traces_fall_back_to_parts(spark):
    s = symbols(spark, [("f", "F", "func"), ("g", "G", "func"), ("h", "H", "func")])
    literals = spark.createDataFrame([("1", "URL", "f"), ("2", "MY_URL", None), ("3", "OLD", "gone")], "id string, value string, enclosing_id string")
    edges = spark.createDataFrame([("g", "f"), ("h", "f"), ("g", "f")], "caller_id string, callee_id string")
    asked = spark.createDataFrame([("URL",), ("MY",), ("OLD",), ("x",)], "query string")
    got = {(r["query"], r.id): (r.tier, r.enclosing_name, r.callers) for r in V.traced(asked, literals, s, edges, 5).collect()}
    assert got == {("URL", "1"): (1, "F", ["G", "H"]), ("MY", "2"): (2, None, None), ("OLD", "3"): (1, None, None)}


def test_members_of_types(spark):
    s = symbols(spark, [("t", "T", "struct", "", "p", "a.go", None, 1, 9), ("u", "U", "struct", "", "p", "b.go", None, 1, 9), ("m", "Do", "method", "", "q", "z.go", "(*T)", 3, 4), ("n", "Do", "method", "", "p", "z.go", "(U)", 5, 6), ("x", "X", "field", "", "p", "a.go", None, 2, 2), ("y", "Y", "field", "", "p", "a.go", None, 10, 10)])
    refs = spark.createDataFrame([("u", "a.go", 4, "*p.U // the rest"), ("u", "a.go", 5, "f U"), ("u", "b.go", 50, "U"), ("t", "b.go", 2, "T"), ("x", "b.go", 3, "X")], "symbol_id string, file_path string, line int, snippet string")
    members = M.type_members(s, refs)
    assert {tuple(r) for r in members.collect()} == {("t", "method", "Do", 3), ("u", "method", "Do", 5), ("t", "field", "X", 2), ("u", "embed", "T", 2)}
    assert {tuple(r) for r in M.richness(members).collect()} == {("t", 2), ("u", 2)}


def test_emitted_texts_can_be_read(spark):
    rows = [("a\"b\nc", 1, None, True), ("é\t", None, 2.5, False), (None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, n int, d double, b boolean")
    items = [r.yaml for r in sinks.as_yaml(df).collect()]
    for item, row in zip(items, rows, strict=True):
        fields = dict(line.strip().split(": ", 1) for line in item[2:].split("\n") if line.strip())
        assert {k: json.loads(v) for k, v in fields.items()} == {k: v for k, v in zip("sndb", row, strict=True) if v is not None}
    assert [r.text for r in sinks.as_text(df).collect()] == ["a\"b c\t1\t\ttrue", "é \t\t2.5\tfalse", "\t\t\t"]


def test_manifests(spark):
    from codeloom.sources import readers

    texts = {
        "a": "version: 1\nrules:\n- name: r1 # why\n  from: a/b\n  to: \"c d\"\n  kinds: [x, 'y z', ]\n- to: t\n  from: f\n  allow:\n  - one\n  - \"two\"\n  include_tests: true\nlayers:\n- from: no\n  to: no\n",
        "b": "rules:\r\n    - from: x\r\n      to: y\r\n", "c": "rules:\n", "d": "components: {}\n", "e": None, "f": "rules:\n  - name: only\n    to: y\n  - from: p\n    to: q#r\n",
    }
    got = sorted((r.path, r.place, r.rule, r.from_grp, r.to_grp, r.kinds, r.allow, r.include_tests) for r in readers.manifest_rules(spark.createDataFrame(list(texts.items()), "path string, text string")).collect())
    assert got == [("a", 1, "r1", "a/b", "c d", ["x", "y z"], [], False), ("a", 2, "", "f", "t", [], ["one", "two"], True), ("b", 1, "", "x", "y", [], [], False), ("f", 2, "", "p", "q#r", [], [], False)]
