"""Stores, jobs and watches that are broken off on the way: what is read afterwards equals the batch result."""

import pytest
from pyspark.sql import functions as F

from codeloom.sources import snapshots as N
from codeloom.streaming import jobs as J
from codeloom.streaming.feeds import event_stream, run_available


def table(spark, rows, ddl="id string, n long"):
    return spark.createDataFrame(rows, ddl)


def broken(df):
    """A table that fails while it is computed."""
    return df.withColumn("n", F.when(F.col("n") >= 0, F.raise_error(F.lit("broken"))).otherwise(F.col("n")).cast("long"))


def test_all_tables_switch_at_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert N.snapshot(spark, root) == {} and N.latest(spark, root) == (0, {})
    a = table(spark, [("x", 1)])
    assert N.commit(spark, root, {"a": a, "b": a, "c": a}) == 1
    held = N.snapshot(spark, root)
    with pytest.raises(Exception, match="broken"):  # the first table is staged, the second fails
        N.commit(spark, root, {"a": table(spark, [("y", 2)]), "b": broken(a)})
    rows = lambda t: sorted(map(tuple, t.collect()))
    assert {n: rows(t) for n, t in N.snapshot(spark, root).items()} == {n: [("x", 1)] for n in "abc"}
    assert N.commit(spark, root, {"a": table(spark, [("y", 2)]), "b": table(spark, [], "other int")}, drop=("c",)) == 2
    now = N.snapshot(spark, root)
    assert sorted(now) == ["a", "b"] and rows(now["a"]) == [("y", 2)] and now["b"].columns == ["other"] and now["b"].count() == 0
    assert rows(held["a"]) == [("x", 1)] and rows(N.snapshot(spark, root, 1)["c"]) == [("x", 1)]  # readers keep what they opened
    assert N.sweep(spark, root, keep=2) == 2  # what the broken commit had staged
    assert N.sweep(spark, root, keep=1) == 3 and rows(N.snapshot(spark, root)["a"]) == [("y", 2)]
    with pytest.raises(ValueError):
        N.snapshot(spark, root, 1)


def test_one_of_two_commits_upon_a_snapshot_fails(spark, tmp_path, monkeypatch):
    root, a = f"file://{tmp_path}", table(spark, [("x", 1)])
    N.commit(spark, root, {"a": a})
    N.commit(spark, root, {"a": a}, base=1)
    with pytest.raises(N.Conflict):
        N.commit(spark, root, {"a": a}, base=1)
    number, held = N.latest(spark, root)
    publish = N._publish

    def late(spark_, root_, n, tables):  # another commit comes between reading and publishing
        monkeypatch.setattr(N, "_publish", publish)
        publish(spark_, root_, n, held)
        publish(spark_, root_, n, tables)

    monkeypatch.setattr(N, "_publish", late)
    with pytest.raises(N.Conflict):
        N.commit(spark, root, {"a": a})
    assert N.latest(spark, root)[0] == number + 1


def test_a_torn_manifest_is_not_there(spark, tmp_path):
    root, a = f"file://{tmp_path}", table(spark, [("x", 1)])
    N.commit(spark, root, {"a": a})
    (tmp_path / "manifests" / f"{2:012d}").write_text('{"name": "a", "fold')
    (tmp_path / "manifests" / f"{3:012d}").write_text("")
    assert N.latest(spark, root)[0] == 1 and N.snapshot(spark, root)["a"].count() == 1
    assert N.commit(spark, root, {"b": a}) == 4 and sorted(N.snapshot(spark, root)) == ["a", "b"]


def test_index_write_keeps_children_of_surviving_symbols(spark, tmp_path):
    root = f"file://{tmp_path}"
    symbols = table(spark, [("s1",), ("s2",), ("s3",)], "id string")
    refs = table(spark, [("s1", "s2", ""), ("s3", None, ""), ("s9", "s1", ""), ("s2", "s9", "")], "symbol_id string, enclosing_id string, ast_ctx string")
    edges = table(spark, [("s1", "s2"), ("s3", "s1"), ("s9", "s1")], "caller_id string, callee_id string")
    kids = table(spark, [("s1", 1), ("s3", 3)], "symbol_id string, v int")
    N.commit_index(spark, root, symbols, refs, edges, {"embeddings": kids, "symbol_purposes": kids, "imports": kids})
    now = N.snapshot(spark, root)
    assert now["refs"].count() == 2 and now["call_graph"].count() == 2
    few = symbols.filter("id <> 's3'")
    with pytest.raises(Exception, match="broken"):
        N.commit_index(spark, root, few, refs, edges.withColumn("callee_id", F.raise_error(F.lit("broken")).cast("string")))
    assert N.snapshot(spark, root)["embeddings"].count() == 2
    N.commit_index(spark, root, few, refs, edges)
    now = N.snapshot(spark, root)
    assert [r.symbol_id for r in now["embeddings"].collect()] == ["s1"] == [r.symbol_id for r in now["symbol_purposes"].collect()]
    assert now["imports"].count() == 2 and now["refs"].count() == 1 and now["call_graph"].count() == 1


def test_job_is_taken_up_where_it_broke_off(spark, tmp_path):
    rows = table(spark, [(f"k{k:03d}", f"text {k}") for k in range(95)] + [("k000", "a twin"), (None, "no key")], "id string, text string").repartition(4)
    job = J.BatchJob(rows, "id", "text", str(tmp_path), 10)
    assert job.batches == list(range(10)) and job.status() == "missing" and job.results() is None
    fails = lambda at: lambda x: x.select("id", F.when(F.col("id") == at, F.raise_error(F.lit("broken"))).otherwise(F.length("text")).cast("long").alias("n"))
    with pytest.raises(Exception, match="broken"):
        job.run(fails("k043"))
    assert job.done() == [0, 1, 2, 3] and job.status() == "in_progress" and job.results().count() == 40
    (tmp_path / job.hash / "batches" / "batch=4").mkdir(exist_ok=True)
    (tmp_path / job.hash / "batches" / "batch=4" / "part-0.parquet").write_bytes(b"half")  # left by the broken run
    again = J.BatchJob(rows.repartition(2), "id", "text", str(tmp_path), 10)
    assert again.hash == job.hash and again.pending() == [4, 5, 6, 7, 8, 9]
    assert again.run(fails("none"), most=2) == 2 and again.run(fails("none")) == 4 and again.run(fails("none")) == 0
    got = sorted((r.id, r.n, r.batch) for r in again.results().collect())
    assert got == [(f"k{k:03d}", 6 if k == 0 else len(f"text {k}"), k // 10) for k in range(95)]
    other = J.BatchJob(rows.filter("id <> 'k001'"), "id", "text", str(tmp_path), 10)  # another generation begins anew
    assert other.hash != job.hash and other.done() == [] and again.status() == "completed"
    assert J.BatchJob(rows.limit(0), "id", "text", str(tmp_path), 10).status() == "completed"


def test_many_batches_are_few_jobs(spark, tmp_path):
    rows = table(spark, [(f"k{k:03d}", f"text {k}") for k in range(95)], "id string, text string")
    fails = lambda at, gone=-1: lambda x: x.filter(F.col("batch") != gone).select("id", "batch", F.when(F.col("id") == at, F.raise_error(F.lit("broken"))).otherwise(F.length("text")).cast("long").alias("n"))
    calls = []
    counted = lambda made: lambda x: (calls.append(1), made(x))[1]
    job = J.BatchJob(rows, "id", "text", str(tmp_path), 5)
    assert job.run(fails("none"), most=1, together=50) == 1 and job.done() == [0]
    with pytest.raises(Exception, match="broken"):
        job.run(fails("k043"), together=50)
    assert job.done() == list(range(8))  # those before the broken one are done
    (tmp_path / job.hash / "batches" / "batch=9").mkdir(exist_ok=True)
    (tmp_path / job.hash / "batches" / "batch=9" / "part-0.parquet").write_bytes(b"half")
    again = J.BatchJob(rows, "id", "text", str(tmp_path), 5)
    assert again.run(counted(fails("none", gone=12)), together=50) == 11 and len(calls) == 2  # all at once, then the empty one
    got = sorted((r.id, r.n, r.batch) for r in again.results().collect())
    assert got == [(f"k{k:03d}", len(f"text {k}"), k // 5) for k in range(95) if k // 5 != 12] and again.status() == "completed"


@pytest.fixture
def changes(spark, tmp_path):
    """Changes of 7 paths in 9 files; the last of a path is not always in the last file."""
    rows = [(f"p{(3 * k) % 7}", (k * 37) % 90, k, f"v{k}") for k in range(90)]
    for f in range(9):
        table(spark, rows[10 * f : 10 * f + 10], "path string, ts long, id long, hash string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {}
    for r in rows:
        if r[0] not in want or r[1:3] > want[r[0]][1:3]:
            want[r[0]] = r
    return str(tmp_path / "in"), sorted(want.values())


def watch(spark, tmp_path, at, each, apply=None):
    order = ["ts", "id"]
    return J.Watch(event_stream(spark, at, each), "path", order, apply or J.upserted(str(tmp_path / "store"), "path", order), str(tmp_path / "progress"))


def found(spark, tmp_path):
    return sorted(map(tuple, N.snapshot(spark, str(tmp_path / "store"))["changes"].select("path", "ts", "id", "hash").collect()))


@pytest.mark.parametrize("each", [1, 4, 100])
def test_watch_equals_the_batch_fold(spark, tmp_path, changes, each):
    at, want = changes
    w = watch(spark, tmp_path, at, each)
    assert w.drain(limit_s=300) and found(spark, tmp_path) == want
    assert sum(e["event"] == "reindexed" for e in w.log) == -(-9 // each)
    assert sorted(map(tuple, J.last_changes(spark.read.parquet(at), "path", ["ts", "id"]).collect())) == want


def test_a_batch_that_fails_is_run_again_with_what_came_since(spark, tmp_path, changes):
    at, want = changes
    put, seen = J.upserted(str(tmp_path / "store"), "path", ["ts", "id"]), []

    def once(folded, number):
        seen.append((number, folded.count()))
        if number == 3 and sum(n == 3 for n, _ in seen) < 3:
            put(folded, number)  # what it did is there already when it breaks
            raise RuntimeError("broken")
        put(folded, number)

    w = watch(spark, tmp_path, at, 2, once)
    assert not w.drain(limit_s=300) and not w.drain(limit_s=300)
    table(spark, [("new", 1, 1000, "v")], "path string, ts long, id long, hash string").coalesce(1).write.mode("append").parquet(at)
    assert w.drain(limit_s=300)
    assert found(spark, tmp_path) == sorted([*want, ("new", 1, 1000, "v")])
    assert [e["event"] for e in w.log].count("error") == 2 and sum(n == 3 for n, _ in seen) == 3


def test_drain_stops_within_its_limit_and_goes_on_later(spark, tmp_path, changes):
    import time

    at, want = changes
    put = J.upserted(str(tmp_path / "store"), "path", ["ts", "id"])
    slow = lambda folded, number: (put(folded, number), time.sleep(1.0))
    w = watch(spark, tmp_path, at, 1, slow)
    running = w.start()
    time.sleep(2.5)
    began = time.time()
    assert not w.drain(running, limit_s=1.5) and time.time() - began < 12
    assert w.log[-1] == {"event": "stopped", "drained": False}
    assert watch(spark, tmp_path, at, 100).drain(limit_s=300) and found(spark, tmp_path) == want


def test_catch_up_before_a_read(spark, tmp_path, changes):
    at, want = changes
    present = table(spark, [(r[0], r[3]) for r in want], "path string, hash string")
    stored = table(spark, [(r[0], r[3]) for r in want[:4]] + [("gone", "x"), (want[4][0], "old")], "path string, hash string")
    n = J.drift(stored, present)
    assert n == 4 and J.drift(present, present) == 0  # two added, one changed, one deleted
    w = watch(spark, tmp_path, at, 3)
    assert J.healed(w, 0, True) == (False, "") and J.healed(w, 3, False) == (False, "the build has changed")
    assert J.healed(w, 21, True) == (False, "21 files changed") and J.healed(w, 1, True, enabled=False) == (False, "1 file changed")
    assert w.log == []
    healed, why = J.healed(w, n, True, limit_s=0.0)
    assert not healed and "did not end" in why
    assert J.healed(w, n, True, limit_s=300) == (True, "") and found(spark, tmp_path) == want


def test_usage_stream_equals_its_batch_form(spark, tmp_path):
    lines = ['{"ts":"2024-01-01T00:00:00Z","cmd":"a","outcome":"ok","ms":5}', '{"cmd":"a","outcome":"error","ms":7}', '{"cmd":"b"', "", "null", "[1]", '{"outcome":"ok"}', '{"cmd":"b","outcome":"ok"}', "no json"]
    for k in range(3):
        table(spark, [(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "log"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "log"))
    got = run_available(J.usage_counts(J.usage_rows(stream)), "usage_test", "complete", str(tmp_path / "cp")).collect()
    want = J.usage_counts(J.usage_rows(spark.read.text(str(tmp_path / "log")))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [("a", 6, 3, 36, 50.0), ("b", 3, 0, 0, 0.0)]
