"""Facts of an architecture on small tables with known answers."""

from codeloom.literals import literal_rows
from codeloom.operators import facts as X
from pyspark.sql import functions as F


def test_drivers_match_whole_segments(spark):
    x = literal_rows(spark, [("a/pq",), ("a/pq/b",), ("pq",), ("a/pqx",), (None,)], "p string")
    got = {r.p: r.t for r in x.select("p", X.driver_of(F.col("p"), [("pq", "sql"), ("a", "other")]).alias("t")).collect()}
    assert got == {"a/pq": "sql", "a/pq/b": "sql", "pq": "sql", "a/pqx": "other", None: None}
    assert x.select(X.driver_of(F.col("p"), []).alias("t")).filter("t is not null").count() == 0


def test_hosts(spark):
    x = literal_rows(spark, [("github.com/a/b/c",), ("x.org/a/b",), ("x.org",), ("fmt",), ("net/http",)], "p string")
    assert [r.h for r in x.select(X.host_root(F.col("p")).alias("h")).collect()] == ["github.com/a/b", "x.org/a", "x.org", None, None]


def test_embedded_snippets(spark):
    rows = [("*pkg.T", True), ("T // note", False), ("T //note", True), ("T `json`", False), ("T{", True), ("t T", False), ("", False), (None, None)]
    x = literal_rows(spark, [(s,) for s, _ in rows], "s string")
    assert [r.e for r in x.select(X.embeds(F.col("s"), F.lit("T")).alias("e")).collect()] == [e for _, e in rows]


def test_build_targets_prefer_documented_ones(spark):
    lines = [("a", 1, ".PHONY: x y"), ("a", 2, "build: dep ## builds"), ("a", 3, "$(v): ## no"), ("b", 1, ".PHONY: y  z y"), ("b", 2, "z:"), ("c", 1, "plain")]
    got = X.build_targets(literal_rows(spark, lines, "path string, line_no int, line string"))
    assert sorted((r.path, r.target, r.place) for r in got.collect()) == [("a", "build", 1), ("b", "y", 1), ("b", "z", 2)]


def test_backfill_and_healing(spark):
    meta = literal_rows(spark, [("metrics_version", "3"), ("x", "1")], "key string, value string")
    assert X.needs_backfill(meta, "3").first().backfill is False
    assert X.needs_backfill(meta, "4").first().backfill is True
    assert X.needs_backfill(meta.limit(0), "3").first().backfill is True
    x = literal_rows(spark, [(0, True), (20, True), (21, True), (5, False), (5, None)], "n int, same boolean")
    assert [r.h for r in x.select(X.should_heal(F.col("n"), F.col("same")).alias("h")).collect()] == [False, True, False, False, False]


def test_a_broken_off_job_goes_on_where_it_was(spark):
    texts = literal_rows(spark, [("a", "1"), ("b", "2"), ("c", None)], "symbol_id string, text string")
    first = X.pending(texts, texts.select("symbol_id", F.lit("").alias("fingerprint")).limit(0), "v")
    assert first.count() == 3
    assert {r.symbol_id for r in X.pending(texts, first.filter("symbol_id = 'a'"), "v").collect()} == {"b", "c"}
    assert X.pending(texts, first, "v").count() == 0 and X.pending(texts, first, "w").count() == 3


def test_places_over_several_ranges(spark):
    from codeloom.operators.ranks import numbered

    x = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("v"))
    got = numbered(x, [F.col("v").desc(), "k"]).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (-r.v, r.k))] == list(range(1, 5001))
    ties = numbered(x.withColumn("v", F.lit(None).cast("long")), ["v", "k"]).collect()
    assert [r["rank"] for r in sorted(ties, key=lambda r: r.k)] == list(range(1, 5001))
    assert numbered(x.limit(0), ["k"]).count() == 0
