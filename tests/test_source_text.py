"""Expressions and operators over source text against small parsers written another way."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import code_text as T
from codeloom.operators import conventions as C
from codeloom.operators import source_text as X
from codeloom.sources import snapshots


def values(spark, texts, *columns):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", *columns)
    return [tuple(r)[1:] for r in sorted(df.collect())]


def items(text):
    out, depth, at = [], 0, ""
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(at)
            at = ""
        else:
            at += c
    return [x.strip(" ") for x in [*out, at]] if text.strip(" ") else []


def close(text, at):
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    return -1


def parts(sig):
    t = re.sub("^func", "", (sig or "").strip(" ")).strip(" ")
    if t.startswith("(") and close(t, 0) > 0:
        t = t[close(t, 0) + 1 :].strip(" ")
    begin = t.find("(")
    end = close(t, begin) if begin >= 0 else -1
    if end < 0:
        return [], [], False
    rest = t[end + 1 :].strip(" ")
    results = [] if not rest else [rest] if rest[0] != "(" else items(rest[1 : close(rest, 0)]) if close(rest, 0) > 0 else []
    return items(t[begin + 1 : end]), results, "..." in t[begin + 1 : end]


def test_signatures(spark):
    rng = random.Random(8)
    texts = ["func Load(cfg C) (*R, error)", "func (*W) Write(cmd string, err *E) error", "func F(f func(a, b int) (c, d int), m map[K]func(x, y int)) chan int", "func F(", "F", "", None, "func (t T) M[K any](xs ...K)", "func(a int)", "func () F() ()"]
    texts += ["func " + "".join(rng.choice("()[]{},, ab.") for _ in range(rng.randrange(30))) for _ in range(300)]
    got = values(spark, texts, T.signature_parts(F.col("t")).alias("p"))
    assert [(r[0].params, r[0].results, r[0].variadic) for r in got] == [parts(t) for t in texts]
    assert parts(texts[2]) == (["f func(a, b int) (c, d int)", "m map[K]func(x, y int)"], ["chan int"], False)


def test_places_of_matches(spark):
    rng = random.Random(3)
    texts = ["", None, "aa", "xaay aa", "é aa 😀 aa"] + ["".join(rng.choice("ab é😀") for _ in range(rng.randrange(40))) for _ in range(200)]
    with pytest.raises(ValueError):
        T.matches(F.col("t"), "a*")
    for pattern in ("a+", "ab|b", "[^a]", "(a)(b)?"):
        want = [[(m.start() + 1, m[0]) for m in re.finditer(pattern, t or "") if m[0]] for t in texts]
        assert [[tuple(m) for m in r[0]] for r in values(spark, texts, T.matches(F.col("t"), pattern))] == want


def scan(src):
    """Raw strings, and the text without comments and strings, character by character."""
    raw, plain, i = [], "", 0
    while i < len(src):
        two, c = src[i : i + 2], src[i]
        if two == "//":
            end = src.find("\n", i)
            end = len(src) if end < 0 else end
        elif two == "/*":
            end = src.find("*/", i + 2)
            end = len(src) if end < 0 else end + 2
        elif c in "\"'":
            end = i + 1
            while end < len(src) and src[end] not in (c, "\n"):
                end += 2 if src[end] == "\\" and end + 1 < len(src) else 1
            end = min(end + 1, len(src))
        elif c == "`":
            end = src.find("`", i + 1)
            if end > 0:
                raw.append(src[i + 1 : end])
            end = len(src) if end < 0 else end + 1
        else:
            plain, i = plain + c, i + 1
            continue
        plain, i = plain + re.sub("[^\n]", " ", src[i:end]), end
    return raw, plain


def test_comments_and_strings(spark):
    rng = random.Random(2)
    pieces = ["`", '"', "'", "\\", "//", "/*", "*/", "\n", "x", " go f()", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(800)] + ["", "`" + "a\\b\n" * 5000 + "`", '"' + "\\n" * 3000 + '"', '"' + "a" * 100_000 + '" y']
    got = values(spark, texts, T.raw_strings(F.col("t")), T.blanked(F.col("t")))
    assert [(r[0], r[1]) for r in got] == [scan(t) for t in texts]


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("*.go", ["a.go", "x/y/a.go"], ["a.gox", "a.txt"]), ("vendor", ["vendor/a", "x/vendor/y/z", "vendor"], ["vendors/a", "x/myvendor"]), ("cmd/*.go", ["cmd/a.go"], ["x/cmd/a.go", "cmd/x/a.go"]), ("cmd/**", ["cmd/a", "cmd/x/y"], ["x/cmd/a"]),
    ("**/test/*.go", ["test/a.go", "x/y/test/b.go"], ["test/x/a.go"]), ("a?[0-9x].c", ["ab1.c", "z/abx.c"], ["a/1.c", "ab.c"]), ("[!a]b", ["cb"], ["ab"]), ("*.{go,mod}", ["a.go", "x/go.mod"], ["a.sum"]), ("doc/", ["doc/a", "x/doc/b"], ["doc"]), ("a+(b).go", ["a+(b).go"], ["aab.go"]),
])
def test_globs(glob, yes, no):
    assert all(re.search(T.glob_pattern(glob), p) for p in yes) and not any(re.search(T.glob_pattern(glob), p) for p in no)


def test_search_and_context(spark):
    files = {"a.go": ["x one", "é one two one", "", "no", "one", "z", "z", "z", "z", "one"], "vendor/b.go": ["one"], "c.txt": ["one"], "d_test.go": ["one"], "e.go": [None, "z"]}
    lines = spark.createDataFrame([(p, k + 1, t) for p, ls in files.items() for k, t in enumerate(ls)], "path string, line int, text string")
    hits = X.search(lines, "one", ["*.go", "!*_test.go"])
    assert sorted(tuple(r)[:5] for r in hits.collect()) == [("a.go", 1, 3, 6, "one"), ("a.go", 2, 4, 7, "one"), ("a.go", 2, 12, 15, "one"), ("a.go", 5, 1, 4, "one"), ("a.go", 10, 1, 4, "one")]
    assert sorted({r.path for r in X.search(lines, "one").collect()}) == ["a.go", "c.txt", "d_test.go"]
    assert X.search(lines, "one", ["!*.go"]).select("path").distinct().collect()[0].path == "c.txt"
    got = sorted((r.block, r.line, r.is_match) for r in X.with_context(lines, hits, 1).collect())
    assert got == [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, False), (1, 5, True), (1, 6, False), (9, 9, False), (9, 10, True)]
    assert X.with_context(lines, hits.limit(0), 1).count() == 0


def test_schema_precedence(spark):
    make = "create table t (x int);"
    rows = [
        ("r1", "migrations/1.sql", "insert 1"), ("r1", "db/migrations/2.sql", make), ("r1", "db/migrations/1.SQL", "-- first"), ("r1", "db/migrations/x/3.sql", make), ("r1", "schema.sql", make), ("r1", "a/b.go", f"// `\nvar x = `{make}`"),
        ("r2", "db/schema.sql", make), ("r2", "sql/schema.sql", make), ("r2", "schema.sql", "drop"), ("r2", "a_test.go", f"`{make}`"), ("r2", "vendor/a.go", f"`{make}`"), ("r2", "z.go", None), ("r3", "m.go", f'"{make}" + `x`'),
    ]
    got = sorted(map(tuple, X.schemas(spark.createDataFrame(rows, "root string, path string, text string")).collect()))
    assert got == [("r1", "a/b.go", "a", make), ("r1", "db/migrations", "migrations", f"-- 1.SQL\n-- first\n\n-- 2.sql\n{make}"), ("r2", "db/schema.sql", "schema", make)]


def test_concurrency_references(spark):
    code = ["go f()", "x := <-ch", "ch <- <-in", "func(c <-chan int, d chan<- int)", '"go g()" // go h()', "logo f()", "go func() { ch <- 1 }()"]
    lines = spark.createDataFrame([("a.go", k + 1, t) for k, t in enumerate(code)] + [("b.go", 1, "go f()")], "path string, line int, text string")
    symbols = spark.createDataFrame([("big", "func", "a.go", 1, 9), ("small", "method", "a.go", 2, 3), ("type", "struct", "a.go", 1, 1)], "id string, kind string, file_path string, line_start int, line_end int")
    got = sorted((r.line, r.col, r.ast_ctx, r.symbol_id) for r in X.concurrency_refs(lines, symbols).collect())
    assert got == [(1, 1, "go", "big"), (2, 6, "chan", "small"), (3, 4, "chan", "small"), (3, 7, "chan", "small"), (7, 1, "go", "big"), (7, 16, "chan", "big")]


def test_conventions_of_few_and_none(spark):
    ddl = "name string, kind string, signature string, receiver string, file_path string"
    assert C.detected(spark.createDataFrame([], ddl)).collect() == []
    rows = [("NewA", "func", "func() (A, error)", None, "a/x.go"), ("NewB", "func", "func() B", None, "a/x.go"), ("NewC", "func", None, None, "a/x_test.go"), ("m", "method", None, "(*s)", "a/x.go"), ("n", "method", None, "(Server)", "a/x.go"), ("helper", "func", None, None, "b/y_test.go"), ("Er", "interface", None, None, "a/x.go"), ("T", "struct", None, None, "a/x.go"), ("ErrX", "var", None, None, "a/x.go")]
    got = {r.convention: tuple(r)[1:] for r in C.detected(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {
        "constructors": (C.ERROR, "low", 2, 1, 1, None), "receivers": (C.SINGLE, "low", 2, 1, 1, 50.0), "testing": (C.COLOCATED, "low", 2, 1, 1, 1.0), "interfaces": (C.SUFFIX, "low", 1, 1, 0, None), "errors": (C.BOTH, "low", 2, 1, 1, None), "file_org": (C.MANY, "low", 1, 0, 1, 2.0),
    }


def test_steps_stand_on_their_own(spark, tmp_path):
    root, one = f"file://{tmp_path}", spark.range(1)
    fails = lambda t: one.select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    first = C.run_steps(spark, root, [("a", lambda t: one, ()), ("b", lambda t: one, ("a",))])
    assert sorted(map(tuple, first.collect())) == [("a", "ok", None), ("b", "ok", None)]
    again = {r.name: (r.status, r.error) for r in C.run_steps(spark, root, [("a", fails, ()), ("b", lambda t: t["a"], ("a",)), ("c", lambda t: t["no"], ()), ("d", lambda t: t["b"].union(t["b"]), ())]).collect()}
    assert {n: s for n, (s, _) in again.items()} == {"a": "failed", "b": "skipped", "c": "failed", "d": "ok"} and again["b"][1] == "needs a"
    found = snapshots.snapshot(spark, root)
    assert sorted(found) == ["a", "b", "d", "steps"] and found["a"].count() == 1 and found["d"].count() == 2
