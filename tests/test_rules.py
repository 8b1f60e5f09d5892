"""Each rule on its own: roles, risk flags, lifecycles, entry points, scores."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import exprs as E
from codeloom.operators import classify as K

SYMBOLS = "id string, name string, kind string, signature string, pkg_path string, file_path string, receiver string"


def symbols(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (7 - len(r))) for r in rows], SYMBOLS)


def test_roles(spark):
    want = {
        "main": ("main", "func", "func()", "m/main", "entry_point"), "main elsewhere": ("main", "func", "func()", "m/cmd", "internal"), "cobra": ("RunE", "method", "", "m", "entry_point"), "cobra func": ("RunE", "func", "", "m", "internal"),
        "init": ("init", "func", None, "m", "entry_point"), "exec": ("Execute", "method", "", "m", "entry_point"), "started": ("go", "func", "", "m", "entry_point"), "serve": ("X", "method", "func ServeHTTP(a, b)", "m", "handler"),
        "pair": ("x", "func", "func(W http.ResponseWriter, r *http.Request)", "m", "handler"), "gin": ("x", "func", "func(c *gin.Context)", "store", "handler"), "echo": ("x", "func", "f(c echo.Context)", "m", "handler"), "handler by name only": ("UserHandler", "func", "func()", "m", "internal"),
        "read": ("x", "func", "Read(p []byte) int", "m", "io_primitive"), "close": ("x", "func", "Close() error", "m", "io_primitive"), "factory": ("NewX", "func", "func NewX() *X", "m", "factory"), "two results": ("NewX", "func", "func NewX() (*X, error)", "m", "internal"),
        "pointer parameter": ("NewX", "func", "func NewX(a *A) X", "m", "internal"), "store": ("x", "func", "", "m/DataStore/y", "persistence"), "sql": ("x", "func", "", "m", "persistence"), "shown": ("Shown", "func", "", "m", "api_boundary"),
        "shown to its own": ("Own", "func", "", "m", "internal"), "hidden": ("hid", "func", "", "m", "internal"), "called from nowhere": ("Odd", "func", "", "m", "api_boundary"), "null name": (None, "func", None, None, "internal"),
    }
    rows = [(i, *v[:4], "f.go") for i, v in want.items()] + [("caller", "main", "var", None, "c", "f.go"), ("other", "o", "var", None, "c", "f.go"), ("same", "o", "var", None, "m", "f.go"), ("q", "Query", "func", "", "d", "f.go"), ("nowhere", "n", "var", None, None, "f.go")]
    edges = [("caller", "started"), ("sql", "q"), ("other", "shown"), ("same", "shown"), ("same", "shown to its own"), ("other", "hidden"), ("nowhere", "called from nowhere"), ("gone", "factory")]
    got = {r.id: r.role for r in K.roles(K.call_facts(symbols(spark, rows), spark.createDataFrame(edges, "caller_id string, callee_id string"))).collect()}
    assert {i: got[i] for i in want} == {i: v[4] for i, v in want.items()}
    types = [("a", "X", "struct", None, "m/Store"), ("b", "myReaderX", "interface", None, "m"), ("c", "Big", "type", None, None), ("d", "small", "struct", None, "m"), ("e", "F", "func", None, "m")]
    assert {r.id: r.role for r in K.type_roles(symbols(spark, types)).collect()} == {"a": "persistence", "b": "io_primitive", "c": "api_boundary", "d": "internal"}


@pytest.mark.parametrize(("signature", "ctx", "snippet", "package", "want"), [
    ("func(c chan int)", None, "", "fmt", (True, False)), ("func(e Exchange, chann int)", None, "", "fmt", (False, False)), ("func(x <-chan T)", None, None, None, (True, False)), ("", "go", "", "fmt", (True, False)), ("", "chan", "", None, (True, False)),
    ("", "call:Lock", "", "sync", (True, False)), ("", "call:Load", "", "sync/atomic", (True, False)), ("", "call:Lock", "", "fmt", (False, False)), ("", "Lock", "", "sync", (False, False)), ("", "call:Run", "", "os/exec", (False, True)), ("", "call:Run", "", "fmt", (False, False)),
    ("", None, "c.InsecureSkipVerify = true", "crypto/tls", (False, True)), ("", None, "c.InsecureSkipVerify = true", "net/http", (False, False)), ("", "call:Serve", "", "net/http", (False, True)), (None, "call:ListenAndServeTLS", None, "net/http", (False, True)),
])
def test_risk_flags(spark, signature, ctx, snippet, package, want):
    s = symbols(spark, [("f", "f", "func", signature, "m", "f.go"), ("v", "v", "var", "chan", "m", "f.go")])
    refs = spark.createDataFrame([("f", ctx, snippet), (None, "go", "")], "enclosing_id string, ast_ctx string, snippet string")
    imports = spark.createDataFrame([("f.go", package), ("other.go", "sync")], "file_path string, pkg_path string")
    assert [tuple(r) for r in K.risk_flags(s, refs, imports).collect()] == [("f", *want)]


def test_lifecycles(spark):
    fns = {
        "a": ("f", "func()", "call:DeleteRow", "delete", []), "b": ("f", "func()", "call:Deletes", "read", []), "c": ("f", "func()", "call:delete", "delete", []), "d": ("f", "func()", "call:Exec", "delete", []), "e": ("f", "func()", "lit", "create", []), "g": ("NewT", "func() *T", "", "create", []),
        "h": ("NewT", "func() *Tx", "", "read", []), "i": ("Newest", "func() T", None, "read", []), "j": ("Build", "func() (T, error)", "", "create", []), "k": ("Archive", "", "", "delete", []), "l": ("SetX", "func(t * T)", "", "mutate", []), "m": ("SetX", "func(t T)", "", "read", []),
        "n": ("DeleteT", "", "new", "create", ["delete"]), "o": ("UpdateT", "func(t *T) error", "call:RemoveX", "delete", ["mutate"]), "p": ("MakeT", "func(x) (*T)", "make", "create", []),
    }
    s = symbols(spark, [(i, v[0], "func", v[1], "m", "f.go") for i, v in fns.items()])
    refs = [(f"r{i}", "t", i, f"{i}.go", 1, v[2], "db.Exec('delete from t')") for i, v in fns.items()] + [
        ("x", "t", None, "a_test.go", 2, "lit", ""), ("y", "t", "", "zz_generated_a.go", 3, "go", ""), ("z", "t", None, "a_gen.go", 4, None, None), ("w", "other", "a", "f.go", 1, "lit", ""), ("q", "t", "unknown", "p/q.go", 9, "sig", "")
    ]
    x = K.type_lifecycles(spark.createDataFrame(refs, "id string, symbol_id string, enclosing_id string, file_path string, line int, ast_ctx string, snippet string"), s, spark.createDataFrame([("t", "T")], "symbol_id string, type_name string"))
    got = {r.enclosing_id or r.ref_id: (r.role, r.mixed, r.is_test) for r in x.collect()}
    assert got == {i: (v[3], v[4], False) for i, v in fns.items()} | {"x": ("create", [], True), "y": ("type-use", [], True), "z": ("type-use", [], True), "unknown": ("read", [], False)}


def test_entry_points_and_main_files(spark):
    rows = [("1", "main", "func", "", "m", "cmd/a/main.go"), ("2", "Execute", "method", "", "m", "x.go"), ("3", "runJob", "func", "", "m", "r/cmd/x.go"), ("4", "runJob", "func", "", "m", "r/x.go"), ("5", "runner", "func", "", "m", "r/cmd/x.go"), ("6", "main", "func", "", "m", "a_test.go"), ("7", "main", "var", "", "m", "x.go"), ("8", "NewX", "func", "", "m", "x.go")]
    s = symbols(spark, rows)
    assert sorted((r.priority, r.id) for r in K.entry_points(s).collect()) == [(1, "1"), (2, "2"), (3, "3")]
    many = symbols(spark, [(str(k), "main", "func", "", "m", f"c{k}/main.go") for k in range(9)] + [("m", "main", "func", "", "m", "a/other.go"), ("n", "main", "func", "", "m", "b/main.go", "(*T)")])
    assert [r.file_path for r in K.main_files(many).collect()] == [f"c{k}/main.go" for k in range(5)]


def test_scores(spark):
    ddl = "callers int, importers int, pkg_rank int, pkg_count int, cyclo int, cognitive int, bug_commits int, churn double, flags int, roles int, exported int, changed_funcs int, untested int, degraded string"
    rows = [(20, 5, 1, 4, 10, 15, 5, 10.0, 1, 3, 3, 4, 1, None), (0, 0, None, 4, None, None, None, None, 0, 0, 0, 0, 0, None), (60, 0, 4, 4, 10, None, -1, 0.0, 1, 0, 0, 2, 2, None), (1, 1, 1, 1, 1, 1, 1, 1.0, 1, 1, 1, 1, 1, "no diff")]
    got = [tuple(r) for r in K.assessed(spark.createDataFrame(rows, ddl)).select("reach", "difficulty", "history", "kind", "safety_net", "score").collect()]
    assert got == [(0.667, 0.5, 0.5, 0.5, 0.25, 0.483), (0.0, None, None, 0.0, None, 0.0), (0.333, None, 0.0, 0.167, 1.0, 0.375), (None,) * 6]


def test_callees(spark):
    names = ["Close", "x.Close", "Find", "store.Find", "isGood", "Has", "x.hasIt", "plain", "LockAll", "ReleaseX", "NewContext", "parseError", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(E.significance(F.col("n")), E.callee_note(F.col("n")))
    assert [tuple(r) for r in df.collect()] == [(3, "resource cleanup"), (6, None), (7, None), (10, None), (3, None), (5, None), (6, None), (5, None), (7, "synchronization"), (7, "resource cleanup"), (7, "context propagation"), (5, "error handling"), (5, None)]
