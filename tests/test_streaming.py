"""Streams give what their batch forms give."""

import datetime as dt
import os

import pytest

from codeloom.streaming import feeds as S


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 3, start + dt.timedelta(minutes=7 * k + 40 * (k // 10)), f"f{k % 4}") for k in range(60)]
    df = spark.createDataFrame(rows, "user long, ts timestamp, item string")
    for part in range(3):  # files in time order
        df.orderBy("ts").offset(20 * part).limit(20).coalesce(1).write.mode("append").parquet(path)
    return path


def both(spark, events, tmp_path, name, fn, mode="complete"):
    stream = S.run_available(fn(S.event_stream(spark, events)), name, mode, str(tmp_path / name))
    batch = fn(spark.read.parquet(events))
    return sorted(map(tuple, stream.collect())), sorted(map(tuple, batch.collect()))


def test_tumbling(spark, events, tmp_path):
    got, want = both(spark, events, tmp_path, "tumbling", lambda e: S.tumbling(e, "ts", "user", "30 minutes"))
    assert got == want and want


def test_debounced(spark, events, tmp_path):
    got, want = both(spark, events, tmp_path, "debounced", lambda e: S.debounced(e, "ts", "user", "item", "25 minutes"))
    assert got == want and want


def test_upserts(spark, events, tmp_path):
    q = S.upsert_each(S.event_stream(spark, events, 1), str(tmp_path / "table"), ["user"], "ts", str(tmp_path / "cp"))
    q.awaitTermination()
    last = max((p.name for p in (tmp_path / "table").iterdir()), key=lambda v: int(v[1:]))
    got = {r.user: r.ts for r in spark.read.parquet(str(tmp_path / "table" / last)).collect()}
    want = {r[0]: r[1] for r in spark.read.parquet(events).groupBy("user").agg({"ts": "max"}).collect()}
    assert got == want


def test_late_rows_and_old_versions(spark, tmp_path):
    rows = [("a", 5, 0), ("b", None, 1), ("a", 3, 2), ("b", 1, 3), ("a", 5, 4), ("b", None, 5)]
    for k, row in enumerate(rows):
        at = tmp_path / "in" / f"{k}.parquet"
        at.parent.mkdir(exist_ok=True)
        spark.createDataFrame([row], "name string, ts long, n long").toPandas().astype({"ts": "Int64"}).to_parquet(at)
        os.utime(at, (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema("name string, ts long, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.upsert_each(stream, str(tmp_path / "table"), ["name"], "ts", str(tmp_path / "cp")).awaitTermination()
    left = sorted(p.name for p in (tmp_path / "table").iterdir())
    assert left == ["v4", "v5"]
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "table" / "v5")).collect()} == {("a", 5, 4), ("b", 1, 3)}


def test_decayed_scores(spark, events, tmp_path):
    half = 3600.0
    stream = S.decayed_scores(S.event_stream(spark, events), "user", "ts", half)
    got = {r.key: (r.n, round(r.score, 6)) for r in S.run_available(stream, "decayed", "update", str(tmp_path / "decayed")).orderBy("n").collect()}
    rows = spark.read.parquet(events).collect()
    for user in range(3):
        at = [r.ts.timestamp() for r in rows if r.user == user]
        assert got[str(user)] == (len(at), round(sum(2 ** ((t - max(at)) / half) for t in at), 6))


def test_modes_and_refresh(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "k string, v string")
    one, two = (S.fingerprint(df, "k", "v").first()[0] for df in (a, a.orderBy("v", ascending=False)))
    assert one == two
    assert (S.refresh_mode(None, one, 0), S.refresh_mode(one, one, 0), S.refresh_mode(one, one, 5)) == ("full", "skip", "incremental")
    before = spark.createDataFrame([("a", "t"), ("b", "u")], "symbol_id string, text string")
    after = spark.createDataFrame([("a", "t"), ("b", "new"), ("c", "x")], "symbol_id string, text string")
    assert sorted(r.symbol_id for r in S.needs_embedding(before, after).collect()) == ["b", "c"]
