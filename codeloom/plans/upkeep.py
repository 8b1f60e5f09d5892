"""Queries that write, break off, watch and catch up: stores of snapshots, resumable jobs, streams; with their SQL.

Each keeps its store in a new folder of the shared one, works on whole tables, and returns what a reader
then finds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.lineage import shared_folder
from codeloom.plans.indexed import CG, RF, SYM, Code
from codeloom.plans.registry import Tables, query
from codeloom.sources import snapshots
from codeloom.streaming import jobs as J
from codeloom.streaming.feeds import event_stream, run_available

#: Batches of a job that are computed at once.
TOGETHER = 4096

LAST = "row_number() over (partition by user_id order by ts desc nulls last, event_id desc) = 1"


@query(f"""with {SYM}, {RF}, {CG}, now as (select * from sym where p_size >= 10), old as (select * from sym where p_size <= 40)
select 'symbols' "table", id from now union all select 'refs', id from rf where symbol_id in (select id from now) and enclosing_id in (select id from now)
union all select 'call_graph', concat_ws('>', caller_id, callee_id, line, col) from cg where caller_id in (select id from now) and callee_id in (select id from now)
union all select 'embeddings', id from (select 's' || vec_id id from embeddings) where id in (select id from now) and id in (select id from old) union all select 'imports', id from old where kind = 'func'""")
def snapshot_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1, SK2: an index written whole over another: all tables switch at once, embeddings of symbols that survive
    stay, rows with unknown ends go, and imports, which the second write does not bring, stay as they are."""
    c, root = Code(spark, sf_dir), shared_folder(spark, "index")
    old, now = c.sym.filter("p_size <= 40"), c.sym.filter("p_size >= 10")
    kids = c.t.embeddings.select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("symbol_id"), "embedding")
    snapshots.commit_index(spark, root, old, c.rf, c.cg, {"embeddings": kids.join(old.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi"), "imports": old.filter("kind = 'func'")})
    snapshots.commit_index(spark, root, now, c.rf, c.cg)
    found = snapshots.snapshot(spark, root)
    row = lambda name, key: found[name].select(F.lit(name).alias("table"), key.alias("id"))
    ends = F.concat_ws(">", "caller_id", "callee_id", "line", "col")
    parts = [row("symbols", F.col("id")), row("refs", F.col("id")), row("call_graph", ends), row("embeddings", F.col("symbol_id")), row("imports", F.col("id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""with {SYM} select id symbol_id, ((row_number() over (order by id) - 1) // 700)::int batch, concat_ws(',', length(t) - length(replace(t, 'a', '')), length(t) - length(replace(t, 'e', '')), length(t) - length(replace(t, 'n', '')), length(t)) vec from (select *, name || ' ' || signature t from sym)""")
def resumed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10: vectors of all symbols by a job in batches that is broken off after its first one and taken up again
    by another run, which does what is left."""
    s, root = Code(spark, sf_dir).sym, shared_folder(spark, "job")
    texts = s.select(F.col("id").alias("symbol_id"), F.concat_ws(" ", "name", "signature").alias("text"))
    count = lambda x: F.length("text") - F.length(F.replace(F.col("text"), F.lit(x), F.lit("")))
    vectors = lambda rows: rows.select("symbol_id", "batch", F.concat_ws(",", count("a"), count("e"), count("n"), F.length("text")).alias("vec"))
    J.BatchJob(texts, "symbol_id", "text", root, 700).run(vectors, most=1, together=TOGETHER)
    again = J.BatchJob(texts, "symbol_id", "text", root, 700)
    again.run(vectors, together=TOGETHER)
    return again.results().select("symbol_id", "batch", "vec")


def _dealt(rows: DataFrame, at: str, files: int) -> str:
    rows.repartition(files, "event_id").write.parquet(at)
    return at


@query(f"select user_id, event_id, ts, event_type, value from events qualify {LAST}")
def coalesced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2, ST3: the last change of each user from a stream of changes in many files, two for each batch, each batch
    folded and merged into a store; then what has come is drained."""
    root = shared_folder(spark, "watch")
    e = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type", "value")
    stream = event_stream(spark, _dealt(e, f"{root}/in", 6), 2)
    watch = J.Watch(stream, "user_id", ["ts", "event_id"], J.upserted(f"{root}/store", "user_id", ["ts", "event_id"]), f"{root}/progress")
    if not watch.drain(limit_s=3600):
        raise RuntimeError(str(watch.log[-3:]))
    return snapshots.snapshot(spark, f"{root}/store")["changes"].select("user_id", "event_id", "ts", "event_type", "value")


@query(f"""with a as (select user_id, event_id from events qualify {LAST}), b as (select user_id, event_id from events where event_type <> 'error' qualify {LAST}), n as (select count(*) n from a left join b using (user_id) where b.event_id is null or a.event_id <> b.event_id)
select 'few' "case", user_id, event_id, n > 0 healed, '' stale from a, n union all select 'many', user_id, event_id, false, case when n = 0 then '' else n || case when n = 1 then ' file' else ' files' end || ' changed' end from b, n union all select 'other build', user_id, event_id, false, 'the build has changed' from b""")
def healed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7, ST8: a store that has fallen behind is brought up to date before it is read if few keys have drifted and
    the build is the same; else it is read as it is, with the reason why it may be stale."""
    root = shared_folder(spark, "heal")
    e = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type")
    order, out = ["ts", "event_id"], None
    present = J.last_changes(e, "user_id", order).select("user_id", "event_id")
    late = _dealt(e.filter("event_type = 'error'"), f"{root}/in", 3)
    for case, most, same in (("few", 1 << 40, True), ("many", 0, True), ("other build", 1 << 40, False)):
        at = f"{root}/{case.replace(' ', '_')}"
        snapshots.commit(spark, at, {"changes": J.last_changes(e.filter("event_type <> 'error'"), "user_id", order)})
        watch = J.Watch(event_stream(spark, late), "user_id", order, J.upserted(at, "user_id", order), f"{at}/progress")
        n = J.drift(snapshots.snapshot(spark, at)["changes"], present, "user_id", "event_id")
        healed, stale = J.healed(watch, n, same, most, limit_s=3600)
        rows = snapshots.snapshot(spark, at)["changes"].select(F.lit(case).alias("case"), "user_id", "event_id", F.lit(healed).alias("healed"), F.lit(stale).alias("stale"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""select event_type cmd, count(*)::bigint calls, sum(case when value > 50 then 1 else 0 end)::bigint errors, sum(event_id % 1000)::bigint total_ms, round(100.0 * sum(case when value > 50 then 1 else 0 end) / count(*), 1)::double error_pct from events where event_id % 7 <> 0 group by 1""")
def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11, SC19: calls and errors of each command, counted over a stream of JSON lines of which some are cut off."""
    root = shared_folder(spark, "usage")
    e = Tables(spark, sf_dir).events
    line = F.to_json(F.struct("ts", F.col("event_type").alias("cmd"), F.when(F.col("value") > 50, "error").otherwise("ok").alias("outcome"), (F.col("event_id") % 1000).alias("ms")))
    e.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 30)).otherwise(line).alias("value")).repartition(4).write.text(f"{root}/in")
    lines = spark.readStream.option("maxFilesPerTrigger", 2).text(f"{root}/in")
    return run_available(J.usage_counts(J.usage_rows(lines)), f"usage_{uuid.uuid4().hex}", "complete", f"{root}/progress")
