"""Budgets and caps of groups against brute force, over many ranges and with a hot and a null group."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.operators import lookup as L


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _rows(n):
    return [(None if i % 50 == 7 else "hot" if i % 3 else f"g{i % 11}", i, None if i % 13 == 0 else (i * 37) % 9) for i in range(n)]


@pytest.mark.parametrize("budget", [0, 40, 700, 10**6])
@pytest.mark.parametrize("n", [0, 1, 900])
def test_token_budget(spark, n, budget):
    df = spark.createDataFrame(_rows(n), "grp string, id long, size long").repartition(5)
    found = {(r.grp, r.id, r.running) for r in L.token_budget(df, F.col("size"), budget, ["id"], ["grp"]).collect()}
    groups, want = defaultdict(list), set()
    for g, i, t in _rows(n):
        groups[g].append((i, t or 0))
    for g, rows in groups.items():
        total = 0
        for k, (i, t) in enumerate(sorted(rows)):
            total += t
            if total <= budget or k == 0:
                want.add((g, i, total))
    assert found == want


def test_ranges_split_a_hot_group(spark):
    df = spark.createDataFrame(_rows(900), "grp string, id long, size long")
    dealt = df.filter("grp = 'hot'").repartitionByRange("grp", "id").groupBy(F.spark_partition_id()).count()
    assert dealt.count() > 1


def test_capped_with_exempt(spark):
    rows = [(g, i, None if i % 7 == 0 else i % 5 == 0) for g, i, _ in _rows(300)]
    df = spark.createDataFrame(rows, "grp string, id long, free boolean")
    found = {(r.grp, r.id) for r in L.capped_with_exempt(df, ["grp"], [F.col("id").desc()], F.col("free"), 3).collect()}
    groups = defaultdict(list)
    for g, i, free in rows:
        if not free:
            groups[g].append(i)
    want = {(g, i) for g, i, free in rows if free} | {(g, i) for g, ids in groups.items() for i in sorted(ids)[-3:]}
    assert found == want
