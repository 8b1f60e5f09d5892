"""Operators whose work must not gather in one task: places in skewed groups, siblings, suffix joins."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import exprs as E
from codeloom.operators import aggregates as A
from codeloom.operators import lookup as L


def percentile(values, share=0.95):
    v = sorted(values)
    at = share * (len(v) - 1)
    lo = int(at)
    return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)


def test_places_in_skewed_groups(spark):
    """One group holds most rows, one outlier spans most of its range, one group is all one value."""
    rng = random.Random(7)
    groups = {"hot": [rng.random() for _ in range(20_000)] + [1e12], "flat": [3.0] * 5_000, "few": [1.0, 2.0], "one": [5.0], "nulls": [None, 4.0, None], "none": [None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in A.rollup(df, ["g"], "v").collect()}
    for g, vs in groups.items():
        v = [x for x in vs if x is not None]
        if v:
            assert got[g].p95 == pytest.approx(percentile(v), rel=1e-12) and got[g].largest == max(v) and got[g].n == len(vs)
    assert got["none"].p95 is None


def test_no_range_holds_the_hot_group(spark):
    """With an outlier the values of a group still lie in many ranges, about as many in each."""
    rows = [(0, float(k)) for k in range(40_000)] + [(0, 1e15)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")).repartitionByRange("g", "v")
        sizes = [r["count"] for r in counted.groupBy(F.spark_partition_id()).count().collect()]
        ranks = spark.createDataFrame([(0, 0), (0, 20_000), (0, 40_000)], "g int, rank long")
        assert {r["rank"]: r.v for r in A.values_at_ranks(df, ["g"], "v", ranks).collect()} == {0: 0.0, 20_000: 20_000.0, 40_000: 1e15}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 20 and max(sizes) < 3 * 40_000 / 20


@pytest.mark.parametrize("few", [0, 2, 256])
def test_names_that_are_missed(spark, monkeypatch, few):
    """Few missed names and many take other ways and give the same."""
    monkeypatch.setattr(L, "FEW", few)
    names, asked = ["Alpha", "alpha", "betaAlphaX", "İx", "ab", "", "zz"], ["alpha", "ALPHA", "phax", "b", "zzz", "", "AX", "ab"]
    inputs, table = (spark.createDataFrame([(v,) for v in vs], f"{c} string") for c, vs in (("query", asked), ("name", names)))

    def want(q):
        tiers = [[n for n in names if n == q], [n for n in names if n.lower() == q.lower()], [n for n in names if q.lower() in n.lower()] if q else []]
        return next(({(q, n, k + 1) for n in t} for k, t in enumerate(tiers) if t), set())

    assert {(r.query, r.name, r.tier) for r in L.by_name(inputs, table).collect()} == set().union(*map(want, asked))


def test_suffixes_are_what_suffix_match_finds(spark):
    paths, asked = ["a/b/c", "c", "xc", "b/c", "a//c", "", "c/"], ["c", "b/c", "a/b/c", "x", "", "/c"]
    df = spark.createDataFrame([(p, q) for p in paths for q in asked], "p string, q string")
    for r in df.select("p", "q", E.suffix_match(F.col("p"), F.col("q")).alias("m"), F.array_contains(E.suffixes(F.col("p")), F.col("q")).alias("s")).collect():
        assert r.m == r.s, r
