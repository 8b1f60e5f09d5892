"""Streams: debounced changes, snapshots, upserts, tumbling sessions, decayed scores.

Each stream operator works on batch and streaming DataFrames alike, so a stream can be held against its
batch result. Late data: a watermark of ten minutes unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder, by the schema of what is there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def debounced(events: DataFrame, at: str, key: str, item: str, gap: str, watermark: str = WATERMARK) -> DataFrame:
    """Bursts of events of a key: a burst ends when nothing comes for ``gap``. ``key, start, end, n_events,
    items`` with the sorted distinct items."""
    if events.isStreaming:
        events = events.withWatermark(at, watermark)
    x = events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set(item)).alias("items"))
    return x.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "items")


def tumbling(events: DataFrame, at: str, key: str, size: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """``key, start, n_events`` of fixed windows; the pair names a session."""
    if events.isStreaming:
        events = events.withWatermark(at, watermark)
    return events.groupBy(F.window(at, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("start"), "n_events")


def fingerprint(parts: DataFrame, key: str, value: str) -> DataFrame:
    """One row: a hash of a short list of settings, by key."""
    pairs = F.array_sort(F.collect_list(F.struct(key, value)))
    return parts.agg(F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p[key], p[value])), "\n"), 256).alias("fingerprint"))


def refresh_mode(stored: str | None, now: str, n_changed: int, full_from: int = 1000) -> str:
    """skip, incremental or full, from stored and present fingerprints and the number of changed files."""
    if stored != now:
        return "full"
    return "skip" if n_changed == 0 else "full" if n_changed >= full_from else "incremental"


def refresh_mode_of(same: Column, n_changed: Column, full_from: int = 1000) -> Column:
    """``refresh_mode`` over columns: whether fingerprints are the same, and the number of changed files."""
    return F.when(~same, "full").when(n_changed == 0, "skip").when(n_changed >= full_from, "full").otherwise("incremental")


def needs_embedding(before: DataFrame, after: DataFrame, key: str = "symbol_id", text: str = "text") -> DataFrame:
    """Symbols that are new or whose composed text differs."""
    old = before.select(key, F.col(text).alias("_old"), F.lit(True).alias("_known"))
    return after.join(old, key, "left").filter(F.col("_known").isNull() | ~F.col(text).eqNullSafe(F.col("_old"))).select(after.columns)


class _Decayed(StatefulProcessor):
    """Holds the time of the last event of a key and its score at that time."""

    def __init__(self, half_life_s: float):
        self.half_life_s = half_life_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decayed", "at double, score double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, score, n = self.state.get() if self.state.exists() else (None, 0.0, 0)
        for pdf in rows:
            times = pdf["at_s"].to_numpy()
            last = float(times.max()) if at is None else max(at, float(times.max()))
            if at is not None:
                score *= 2.0 ** ((at - last) / self.half_life_s)
            score += float((2.0 ** ((times - last) / self.half_life_s)).sum())
            at, n = last, n + len(times)
        self.state.update((at, score, n))
        yield pd.DataFrame({"key": [str(key[0])], "at_s": [at], "score": [score], "n": [n]})

    def close(self) -> None:
        pass


def decayed_scores(events: DataFrame, key: str, at: str, half_life_s: float) -> DataFrame:
    """A stream of ``key, at_s, score, n``: after each batch, the decayed count of a key's events as of its
    last one. Needs the RocksDB state store."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("double").alias("at_s"))
    return rows.groupBy("key").transformWithStateInPandas(_Decayed(half_life_s), "key string, at_s double, score double, n long", "Update", "None")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into an in-memory table, and gives that table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def upsert_each(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str):
    """Keeps a folder of versions ``v0, v1, ...``: after each batch the newest one holds, for each key, the row
    that is last by ``order``, also if it came earlier; of equal ones that of the later batch. Rows without an
    order value are older than all. A batch that is run again writes the same version again, from the one
    before, which therefore stays; older ones are deleted. Keys are not null. A version is the whole table,
    written anew in each batch: for tables that are small beside the stream."""
    from codeloom.sources.sinks import first_wins, upsert

    last = [F.col(order).desc_nulls_last(), F.col("_old")]

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_old", F.lit(False))
        if number:
            old = spark.read.parquet(f"{path}/v{number - 1}")
            new = new.unionByName(old.join(batch.select(*key).distinct(), key, "left_semi").withColumn("_old", F.lit(True)))
        new = first_wins(new, key, last).drop("_old")
        (upsert(old, new, key) if number else new).write.mode("overwrite").parquet(f"{path}/v{number}")
        if number > 1:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
