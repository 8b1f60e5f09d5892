"""Steps that once paired all rows of a group: their rows stay as few as what they count or keep."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.operators import facts as X
from codeloom.operators import graph as G
from codeloom.operators import listings as M
from codeloom.operators import paths as P
from codeloom.operators import relations as R
from codeloom.operators import vectors as V


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_fan_out_counts_equal_its_rows(spark):
    sites = table(spark, [(c, i, m) for c in "abc" for i in "xyz" for m in "mno" if (c, m) != ("b", "m")] * 2, "caller_id string, interface_id string, name string")
    methods = table(spark, [("x", "m"), ("x", "n"), ("y", "o"), ("z", "q")], "interface_id string, name string")
    types = table(spark, [("x", 1), ("x", 2), ("x", 2), ("z", 1)], "interface_id string, type_id long")
    want = Counter((r.caller_id, r.interface_id) for r in G.fan_out(sites, methods, types).collect())
    assert {(r.caller_id, r.interface_id): r.n_edges for r in G.fan_out_counts(sites, methods, types).collect()} == want


def test_fan_out_of_many_callers_and_types_is_not_written_out(spark):
    """10**12 calls, which are a product of two counts."""
    sites = spark.range(1000000).select(F.col("id").alias("caller_id"), F.lit("x").alias("interface_id"), F.lit("m").alias("name"))
    types = spark.range(1000000).select(F.lit("x").alias("interface_id"), F.col("id").alias("type_id"))
    got = G.fan_out_counts(sites, table(spark, [("x", "m")], "interface_id string, name string"), types)
    assert got.agg(F.sum("n_edges")).first()[0] == 10**12


SYMBOL = "id string, name string, kind string, receiver string, pkg_path string"


def test_implementer_counts_equal_their_rows(spark):
    have = {"A": "mn", "B": "mno", "C": "o"}
    rows = [(f"{t}{p}{m}", m, "method", f"(*{t})", p) for t, ms in have.items() for p in ("p", "q") for m in ms if (t, p) != ("A", "q")]
    rows += [(f"t{t}{p}{k}", t, "struct", None, p) for t in "ABCD" for p in ("p", "q") for k in range(2)]
    asked = [("i", "m"), ("i", "n"), ("i", "n"), ("j", "n"), ("j", "m"), ("k", "o"), ("l", "none"), ("l", "m"), ("u", "m"), ("u", None)]
    s, need = table(spark, rows, SYMBOL), table(spark, asked, "interface_id string, name string")
    want = Counter(r.interface_id for r in R.implementers(s, need).collect())
    assert want == {"i": 6, "j": 6, "k": 8}
    assert {r.interface_id: r.n_impl for r in R.implementer_counts(s, need).collect()} == want


def test_many_interfaces_of_one_set_are_met_once(spark):
    """200,000 interfaces, each with 200,000 types."""
    n = 200000
    types = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("T").alias("name"), F.lit("struct").alias("kind"), F.lit(None).cast("string").alias("receiver"), F.lit("p").alias("pkg_path"))
    s = types.unionByName(table(spark, [("m", "m", "method", "(T)", "p")], SYMBOL))
    got = R.implementer_counts(s, spark.range(n).select(F.col("id").alias("interface_id"), F.lit("m").alias("name")))
    assert got.agg(F.count("*"), F.sum("n_impl")).first()[:] == (n, n * n)


TYPE = "id string, name string, kind string, receiver string, file_path string, line_start int, line_end int"


def test_richness_of_types_equals_that_of_their_members(spark):
    rows = [(f"t{k}", "TU"[k % 2], "struct", None, f"f{k % 3}", k, k + 40 * (k % 4)) for k in range(24)] + [("v", "V", "struct", None, "g", 1, 1), ("n", None, "type", None, None, None, None)]
    rows += [(f"m{k}", f"n{k % 5}", "method", "(*T)" if k % 3 else "(W)", "h", k, k) for k in range(20)]
    rows += [(f"d{k}", f"n{k % 4}", "field", None, f"f{k % 3}", 5 * k, 5 * k) for k in range(30)]
    s = table(spark, rows, TYPE)
    refs = table(spark, [(f"t{k % 24}", f"f{k % 3}", 3 * k, "TU"[k % 2] if k % 4 else "x y") for k in range(60)], "symbol_id string, file_path string, line int, snippet string")
    want = {r.type_id: r.richness for r in M.richness(M.type_members(s, refs)).collect()}
    assert {r.type_id: r.richness for r in M.type_richness(s, refs).collect()} == want and len(want) > 12 and "v" not in want


def test_methods_of_a_common_receiver_are_spread(spark):
    """A type name with 2,000 types and 2,000 methods: their pairs are in many tasks and in no task all."""
    n = 2000
    row = lambda p, name, kind, receiver: spark.range(n).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("id"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(receiver).cast("string").alias("receiver"), F.lit("f").alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    refs = table(spark, [], "symbol_id string, file_path string, line int, snippet string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in M.type_members(row("t", "T", "struct", None).unionByName(row("m", "m", "method", "(T)")), refs).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n * n and max(sizes) < n * n


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_members_of_types_by_brute_force_and_without_broadcasts(spark, monkeypatch):
    """Methods and types of a name in several blocks; tables that look small on disk are not sent to the driver."""
    monkeypatch.setattr(M, "BLOCK", 4, raising=False)
    monkeypatch.setattr(M, "BLOCKS", 3, raising=False)
    rows = [(f"t{k}", "TUV"[k % 3] if k else None, "struct", None, f"f{k % 3}", k, k + 9) for k in range(40)]
    rows += [(f"m{k}", f"n{k % 5}", "method", "(*T)" if k % 4 else "(U)", "h", k, k) for k in range(30)] + [("m", "n", "method", None, "h", 1, 1)]
    rows += [(f"d{k}", f"n{k % 4}", "field", None, f"f{k % 3}", 2 * k, 2 * k) for k in range(20)]
    s = table(spark, rows, TYPE)
    refs = table(spark, [(f"t{k % 40}", f"f{k % 3}", k, "TUV"[k % 40 % 3]) for k in range(1, 50)], "symbol_id string, file_path string, line int, snippet string")
    got = M.type_members(s, refs)
    types = [r for r in rows if r[2] == "struct"]
    want = Counter((t[0], "method", m[1], m[5]) for t in types for m in rows if m[2] == "method" and m[3] and m[3].strip("(*)") == t[1])
    want += Counter((t[0], "field", d[1], d[5]) for t in types for d in rows if d[2] == "field" and d[4] == t[4] and t[5] <= d[5] <= t[6])
    want += Counter((t[0], "embed", "TUV"[k % 40 % 3], k) for t in types for k in range(1, 50) if k % 40 and t[4] == f"f{k % 3}" and t[5] <= k <= t[6])
    assert Counter(tuple(r) for r in got.collect()) == want
    assert "Broadcast" not in plan_of(got)


def test_least_enclosing_by_brute_force(spark):
    spans = [("f" if k % 3 else "g", k * 7 % 60 - 9, k * 7 % 60 - 9 + k * k % 37 - 1, f"i{k:02}") for k in range(60)]
    points = [(f, n) for f in "fgh" for n in range(-15, 110)]
    got = R.least_enclosing(table(spark, points * 2, "f string, n int"), table(spark, spans, "f string, s int, e int, id string"), ["f"], "n", "s", "e", F.struct((F.col("e") - F.col("s")).alias("d"), "s", "id"))
    want = {(f, n): min((e - s, s, i) for g, s, e, i in spans if g == f and s <= n <= e) for f, n in points if any(g == f and s <= n <= e for g, s, e, _ in spans)}
    assert {(r.f, r.n): tuple(r._best) for r in got.collect()} == want


def many_scopes(spark, n):
    k = F.col("id")
    s = spark.range(n).select(F.format_string("s%07d", k).alias("id"), F.lit("x").alias("name"), F.lit("func").alias("kind"), F.lit("f").alias("file_path"), (k % 5).cast("int").alias("line_start"), (k % 5 + 10).cast("int").alias("line_end"))
    return s.withColumns({"name_line": F.lit(7), "name_col": F.lit(3), "col_start": F.lit(1), "col_end": F.lit(1)})


def test_a_line_inside_all_scopes_of_a_hot_file(spark):
    """300,000 points of one file, each inside 300,000 scopes and beside as many names."""
    n = 300000
    s = many_scopes(spark, n)
    points = spark.range(n).select(F.col("id").alias("point_id"), F.lit("f").alias("file_path"), F.lit(7).alias("line"), F.lit(2).alias("col"))
    found = R.enclosing_or_next(points.drop("col"), s)
    assert [tuple(r) for r in found.groupBy("symbol_id", "tier").count().collect()] == [("s0000000", 1, n)]
    refs = spark.range(n).select(F.lit("f").alias("file_path"), F.lit(7).alias("line"), F.lit(9).alias("col"), F.lit("r").alias("symbol_id"))
    assert [tuple(r) for r in R.resolve_position(points, s, refs).groupBy("symbol_id", "tier").count().collect()] == [("s0000000", 3, n)]


def test_vectors_in_blocks_equal_all_pairs(spark, monkeypatch):
    import random

    monkeypatch.setattr(V, "PAIR_BLOCK", 16)
    rnd = random.Random(5)
    rows = [(f"v{k:03}", "ab"[k % 2], [rnd.gauss(0, 1) for _ in range(4)]) for k in range(120)]
    rows += [("z", "a", [0.0] * 4), ("n", "a", None), ("m", "a", [1.0, None, 1.0, 1.0]), ("s", "a", [1.0, 2.0]), ("q", "a", [float("nan"), 1.0, 1.0, 1.0]), ("v000", "b", [1.0, 1.0, 1.0, 1.0])]
    df = table(spark, rows, "id string, g string, e array<double>")
    a, b = df.select("g", F.col("id").alias("id_a"), F.col("e").alias("x")), df.select("g", F.col("id").alias("id_b"), F.col("e").alias("y"))
    pairs = a.join(b, "g").filter("id_a < id_b").withColumn("s", V.cosine(F.col("x"), F.col("y"))).filter("s >= 0.3")
    got = V.similar_pairs(df, "g", 0.3, "id", "e")
    assert sorted(map(repr, ((r.g, r.id_a, r.id_b, r.similarity) for r in got.collect()))) == sorted(map(repr, ((r.g, r.id_a, r.id_b, r.s) for r in pairs.collect())))
    q = df.filter("id like 'v00%'").select(F.col("id").alias("query_id"), F.col("e").alias("query_vec"))
    best = lambda t: sorted(repr(tuple(r)) for r in V.nearest(q.filter("query_id <> 'v000'"), df, 5, t, vec_id="id", embedding="e").filter("similarity >= 0.1").select("query_id", "id", "similarity", "rank").collect())
    assert best(0.1) == best(-2.0) and len(best(0.1)) > 40


def test_shared_count_without_sets_in_pairs(spark):
    items = table(spark, [(o, i) for o in range(6) for i in range(20) if i % (o + 1) == 0] * 2 + [(1, None), (2, None)], "o long, i long")
    pairs = table(spark, [(1, 2), (0, 5), (3, 9), (1, 2)], "id_a long, id_b long")
    assert sorted(tuple(r) for r in V.shared_count(pairs, items, "o", "i").collect()) == [(0, 5, 4), (1, 2, 4), (1, 2, 4), (3, 9, 0)]


@pytest.mark.parametrize("sent", [0, 1000])
def test_shared_count_of_few_and_of_many_pairs(spark, monkeypatch, sent):
    """Sent or dealt, pairs have the same counts; of few, no pair is dealt that is not asked for."""
    monkeypatch.setattr(V, "SENT", sent, raising=False)
    items = spark.range(2000).select((F.col("id") % 100).alias("o"), F.floor(F.col("id") / 200).alias("i"))
    got = V.shared_count(table(spark, [(1, 2), (3, 500)], "id_a long, id_b long"), items.unionAll(items), "o", "i")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 10), (3, 500, 0)]
    semi = [x for x in plan_of(got).splitlines() if "LeftSemi" in x and "id_b" in x]
    assert bool(semi) == bool(sent) and all("Broadcast" in x for x in semi)


def test_shortest_paths_through_a_dense_layer(spark):
    """Three layers of 1,000 nodes, all of one joined with all of the next: 10**9 steps of the searches, no rows of their own."""
    n = 1000
    k = spark.range(n * n).select((F.col("id") % n).alias("a"), F.floor(F.col("id") / n).alias("b"))
    edges = k.select(F.col("a").alias("src"), (n + F.col("b")).alias("dst")).unionByName(k.select((n + F.col("a")).alias("src"), (2 * n + F.col("b")).alias("dst")))
    got = G.betweenness(edges).groupBy(F.floor(F.col("node") / n).alias("layer")).agg(F.min("value"), F.max("value")).collect()
    want = n / ((3 * n - 1) * (3 * n - 2))
    assert {r.layer: pytest.approx(tuple(r)[1:]) for r in got} == {0: (0, 0), 1: (want, want), 2: (0, 0)}


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_shortest_paths_in_small_blocks_by_brute_force(spark, monkeypatch, dense):
    import random

    for name, v in {"BLOCK": 4, "GROUP": 2, "SOURCES": 3, "DENSE": dense, "ROWS": 2}.items():
        monkeypatch.setattr(P, name, v)
    rnd = random.Random(3)
    e = sorted({(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(75)) if a != b})
    out = {v: [b for a, b in e if a == v] for v in {x for p in e for x in p}}
    want = dict.fromkeys(out, 0.0)
    for s in out:
        order, dist, paths, share = [s], {s: 0}, {s: 1}, dict.fromkeys(out, 0.0)
        for v in order:
            for w in out[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        for v in reversed(order):
            share[v] = sum(paths[v] / paths[w] * (1 + share[w]) for w in out[v] if dist[w] == dist[v] + 1)
            want[v] += share[v] if v != s else 0
    m = (len(out) - 1) * (len(out) - 2)
    got = {r.node: r.value for r in G.betweenness(table(spark, e, "src long, dst long")).collect()}
    assert got == pytest.approx({v: x / m for v, x in want.items()}, abs=1e-12) and max(want.values()) > 20


def test_shortest_paths_of_batches_of_sources(spark, monkeypatch):
    """Edges are made once, and no step holds more than a batch's values, whatever the number of sources."""
    for name, v in {"BLOCK": 8, "GROUP": 2, "SOURCES": 4, "VALUES": 50, "GROWTH": 1}.items():
        monkeypatch.setattr(P, name, v, raising=False)
    held, cut = [], P.cut

    def seen(df):
        x = cut(df)
        held.append(x.agg(F.sum(F.size("at"))).first()[0] or 0 if set(x.columns) >= {"source", "at"} else 0)
        return x

    monkeypatch.setattr(P, "cut", seen)
    n, made = 12, spark.sparkContext.accumulator(0)
    ring = [(k, (k + d) % n) for k in range(n) for d in (1, 5)]
    e = spark.createDataFrame(spark.sparkContext.parallelize(ring, 2).map(lambda x: (made.add(1), x)[1]), "src long, dst long")
    values = [r.value for r in G.betweenness(e).collect()]
    assert made.value == len(ring)
    assert max(held) <= 24  # 36 if all sources were searched from at once
    far = {0: 0}
    for _ in range(n):
        far |= {w: min(far.get(w, n), far[v] + 1) for v in list(far) for a, w in ring if a == v}
    assert values == pytest.approx([sum(x - 1 for x in far.values() if x) / ((n - 1) * (n - 2))] * n)


def test_pairs_of_a_task_stay_as_many(spark, tmp_path, monkeypatch):
    """Three times the rows are dealt to three times the tasks, each with as many pairs as before."""
    monkeypatch.setattr(R, "PAIR_ROWS", 500)
    most = {}
    for n in (10000, 30000):
        spark.range(2 * n).select((F.col("id") % n % 7).alias("a"), (F.col("id") % n).alias("b")).write.parquet(f"{tmp_path}/{n}")
        got = R.counted_pairs(spark.read.parquet(f"{tmp_path}/{n}"), "a", "b")
        assert got.agg(F.count("*"), F.min("n_rows"), F.max("n_rows")).first()[:] == (n, 2, 2)
        most[n] = max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert most[30000] < 1.3 * most[10000] < 1.3 * 500


CALLS = "caller_id long, callee_id long"


def test_ripple_by_brute_force(spark):
    import random

    rnd = random.Random(7)
    ids = [*range(-70, 130, 2), 2**40, 2**40 + 1]
    files = {i: ["a.go", "b.go", "c.go", "a_test.go", None][rnd.randrange(5)] for i in ids}
    kinds = {i: rnd.choice(["func", "method", "var"]) for i in ids}
    s = table(spark, [(i, f"n{i}", kinds[i], files[i]) for i in ids], "id long, name string, kind string, file_path string")
    ends = [*ids, 131, 133]  # the last two are no symbols
    e = [(rnd.choice(ends), rnd.choice(ends)) for _ in range(350)]
    e += [(i, i) for i in ids[::5]] + e[:60] + [(None, ids[0]), (ids[0], None), (None, None)]
    into = {i: {a for a, b in e if b == i and a in files} for i in ends}
    changed = {"a.go", "a_test.go"}
    want = {}
    for i in ids:
        if kinds[i] != "var" and files[i] == "a.go":
            near = into[i].union(*(into[m] for m in into[i]))
            want[i] = sum(files[u] not in changed for u in near)
    got = X.ripple(s, table(spark, e, CALLS), table(spark, [(f,) for f in sorted(changed)] * 2, "file_path string"))
    assert {r.id: r.n_outside for r in got.collect()} == {i: n for i, n in want.items() if n} and max(want.values()) > 5 and 0 in want.values()


def test_ripple_of_a_dense_layer(spark):
    """1,000 changed functions, all called by 1,000 symbols that 1,000 others call: 10**9 paths, no rows of their own."""
    n = 1000
    k, kind = F.col("id"), F.when(F.col("id") < n, "func").otherwise("var")
    s = spark.range(3 * n).select("id", F.lit("x").alias("name"), kind.alias("kind"), F.when(k < 2 * n, "c.go").otherwise("o.go").alias("file_path"))
    pair = spark.range(n * n).select((k % n).alias("a"), F.floor(k / n).alias("b"))
    edges = pair.select((n + F.col("a")).alias("caller_id"), F.col("b").alias("callee_id")).unionByName(pair.select((2 * n + F.col("a")).alias("caller_id"), (n + F.col("b")).alias("callee_id")))
    got = X.ripple(s, edges, table(spark, [("c.go",)], "file_path string"))
    assert got.agg(F.count("*"), F.min("n_outside"), F.max("n_outside")).first()[:] == (n, n, n)


def test_calls_behind_a_ripple_are_dealt_by_their_number(spark, monkeypatch):
    """Three times the calls are met in three times the tasks."""
    monkeypatch.setattr(R, "PAIR_ROWS", 500)
    assert [R.tasks_of(spark.range(n)) for n in (10000, 30000, 1)] == [20, 60, 4]


def test_covering_counts_equal_their_rows_without_broadcasts(spark):
    import random

    rnd = random.Random(11)
    ids = [*range(-70, 130, 2), 2**40, 2**40 + 1]
    s = table(spark, [(i, rnd.choice(["TestA", "x"]), rnd.choice(["a_test.go", "b.go"])) for i in ids], "id long, name string, file_path string")
    ends = [*ids, 131]  # the last is no symbol
    e = [(rnd.choice(ends), rnd.choice(ids)) for _ in range(350)]
    e += [(i, i) for i in ids[::5]] + e[:60] + [(b, a) for a, b in e[:40]] + [(None, ids[0]), (ids[0], None)]
    edges = table(spark, e, CALLS)
    known = edges.join(s.select(F.col("id").alias("caller_id")), "caller_id", "left_semi")
    want = Counter(r.seed for r in R.covering_tests(known, s, edges.select(F.col("callee_id").alias("seed"))).collect())
    got = R.covering_counts(edges, s)
    assert {r.seed: r.n_tests for r in got.collect()} == want and max(want.values()) > 4
    assert "Broadcast" not in plan_of(got)
