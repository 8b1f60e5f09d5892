"""Long jobs that survive being broken off: resumable batches, changes that come during a run, catch-up before a read.

Each keeps what it has done in a folder that driver and executors share, and each gives the same result
however often it is broken off and started again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.ranks import numbered
from codeloom.sources.sinks import first_wins


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def generation(rows: DataFrame, key: str, text: str) -> str:
    """A hash of all rows in any order: sums of their hashes' words, and their number."""
    h = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 256)
    words = [F.coalesce(F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(4)]
    return rows.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *words), 256).alias("g")).first().g


class BatchJob:
    """A job over the rows of a table in numbered batches, keyed by the hash of all its rows.

    ``<root>/<hash>/work`` holds the rows with their batch, ``batches/<n>`` the results and ``done/<n>`` or
    ``done/<first>-<last>`` an empty file for batches that are finished. A batch goes to its own folder and over whatever a broken
    run has left there, and is done only then, so a batch that is run twice has its rows once. Another
    table's rows have another hash: their job begins anew, and ``results`` never mixes the two. Batches have
    ``size`` rows, dealt by ranges of the key; only numbers of batches are held by the driver. Where the caller allows it,
    many batches are one job of Spark's, so the number of jobs does not grow with that of batches.

    Rows without a key stay out; of rows with the same key the one with the smallest text counts; an empty
    table is done at once."""

    def __init__(self, rows: DataFrame, key: str, text: str, root: str, size: int):
        self.spark, self.key = rows.sparkSession, key
        rows = rows.select(key, text).filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias(text))
        self.hash = generation(rows, key, text)
        self.at = f"{root.rstrip('/')}/{self.hash}"
        fs, ready = _fs(self.spark, f"{self.at}/work/_SUCCESS")
        if not fs.exists(ready):
            dealt = numbered(rows, [key], "place").withColumn("batch", F.floor((F.col("place") - 1) / size)).drop("place")
            dealt.write.mode("overwrite").partitionBy("batch").parquet(f"{self.at}/work")
        self.batches = sorted(int(n.split("=")[1]) for n in _names(self.spark, f"{self.at}/work") if n.startswith("batch="))

    def done(self) -> list[int]:
        ends = [n.split("-") for n in _names(self.spark, f"{self.at}/done") if n.replace("-", "").isdigit()]
        return sorted({n for e in ends for n in range(int(e[0]), int(e[-1]) + 1)})

    def pending(self) -> list[int]:
        done = set(self.done())
        return [n for n in self.batches if n not in done]

    def status(self) -> str:
        """``missing``, ``in_progress`` or ``completed``."""
        left = len(self.pending())
        return "completed" if not left else "missing" if left == len(self.batches) else "in_progress"

    def run(self, compute: Callable[[DataFrame], DataFrame], most: int | None = None, together: int = 1) -> int:
        """Computes batches that are not done, ``most`` of them if given; gives their number. ``compute`` takes the
        rows of a batch and gives its results. With ``together`` above 1 it takes those of so many batches at once, with
        their number as ``batch``, which its results keep; if that fails they are computed one by one, so that those
        before a broken one are done."""
        todo = self.pending()[:most]
        for k in range(0, len(todo), max(1, together)):
            wave = todo[k : k + max(1, together)]
            if len(wave) == 1 or not self._wave(compute, wave):
                for n in wave:
                    self._one(compute, n, together > 1)
        return len(todo)

    def _done(self, first: int, last: int) -> None:
        fs, mark = _fs(self.spark, f"{self.at}/done/{first}" + (f"-{last}" if last > first else ""))
        fs.create(mark, True).close()

    def _one(self, compute: Callable[[DataFrame], DataFrame], n: int, named: bool) -> None:
        rows = self.spark.read.parquet(f"{self.at}/work/batch={n}")
        made = compute(rows.withColumn("batch", F.lit(n))).drop("batch") if named else compute(rows)
        made.write.mode("overwrite").parquet(f"{self.at}/batches/batch={n}")
        self._done(n, n)

    def _wave(self, compute: Callable[[DataFrame], DataFrame], wave: list[int]) -> bool:
        """Computes batches in one job; False if it breaks off."""
        left = {f"batch={n}" for n in wave}.intersection(_names(self.spark, f"{self.at}/batches"))
        for name in left:  # of a broken run
            fs, p = _fs(self.spark, f"{self.at}/batches/{name}")
            fs.delete(p, True)
        work = f"{self.at}/work"
        rows = self.spark.read.option("basePath", work).parquet(*(f"{work}/batch={n}" for n in wave))
        try:
            compute(rows).write.mode("append").partitionBy("batch").parquet(f"{self.at}/batches")
        except Exception:  # what went wrong shows when the batches are computed one by one
            return False
        made = set(_names(self.spark, f"{self.at}/batches"))
        full = [n for n in wave if f"batch={n}" in made]
        first = None
        for n, after in zip(full, [*full[1:], None]):
            first = n if first is None else first
            if after != n + 1:
                self._done(first, n)
                first = None
        for n in sorted(set(wave).difference(full)):  # a batch without results still has their columns
            self._one(compute, n, True)
        return True

    def results(self) -> DataFrame | None:
        """The rows of the batches that are done, with their batch; None before the first."""
        done = self.done()
        if not done:
            return None
        at = f"{self.at}/batches"
        return self.spark.read.option("basePath", at).parquet(*(f"{at}/batch={n}" for n in done))


# changes


def last_changes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each path; ``order`` ends in a unique column."""
    return first_wins(changes, [key], [F.col(c).desc_nulls_last() for c in order])


class Watch:
    """Keeps a table of the last change of each path from a stream of changes.

    While a batch is worked on, further changes wait; the next batch takes all that have come and folds them
    to the last change of each path, so a path that changed many times is worked on once. A batch that
    was broken off is run again, with the changes it carried, before newer ones. ``apply`` takes the folded
    changes of a batch and its number and must take a batch twice without effect (``upserted`` does). Changes
    that are older than what the table holds do not undo it. ``log`` lists what happened, as dicts."""

    def __init__(self, stream: DataFrame, key: str, order: list[str], apply: Callable[[DataFrame, int], None], checkpoint: str):
        self.stream, self.key, self.order, self.apply, self.checkpoint, self.log = stream, key, order, apply, checkpoint, []

    def _put(self, batch: DataFrame, number: int) -> None:
        started = time.time()
        self.log.append({"event": "reindex_started", "batch": number})
        try:
            self.apply(last_changes(batch, self.key, self.order), number)
        except Exception as e:
            self.log.append({"event": "error", "batch": number, "error": str(e)[:200]})
            raise
        self.log.append({"event": "reindexed", "batch": number, "ms": round(1000 * (time.time() - started))})

    def start(self, every: str | None = None) -> StreamingQuery:
        """Watches on: a batch as soon as the last one is done, or after each debounce interval ``every``."""
        w = self.stream.writeStream.foreachBatch(self._put).option("checkpointLocation", self.checkpoint)
        return (w.trigger(processingTime=every) if every else w).start()

    def drain(self, running: StreamingQuery | None = None, limit_s: float = 5.0) -> bool:
        """Stops watching, then works on what has come until now, for ``limit_s`` seconds at most. False if
        time ran out or a batch failed: what is left is worked on at the next start."""
        if running is not None and running.isActive:
            running.stop()
        last = self.stream.writeStream.foreachBatch(self._put).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        try:
            ended = last.awaitTermination(limit_s)
        except Exception:  # a batch failed; the log has it
            ended = False
        if not ended and last.isActive:
            last.stop()
        self.log.append({"event": "stopped", "drained": bool(ended)})
        return bool(ended)


def upserted(root: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """An ``apply`` for ``Watch``: a store with the table ``changes``, a snapshot for each batch, and the number of
    its last batch in a table of one row beside it, so that a batch that is run again changes nothing."""
    from codeloom.sources import snapshots

    def apply(folded: DataFrame, number: int) -> None:
        spark = folded.sparkSession
        base, _ = snapshots.latest(spark, root)
        before = snapshots.snapshot(spark, root, base) if base else {}
        if "batch" in before and before["batch"].first().number >= number:
            return
        now = last_changes(before["changes"].unionByName(folded), key, order) if before else folded
        mark = spark.range(1).select(F.lit(number).cast("long").alias("number"))
        snapshots.commit(spark, root, {"changes": now, "batch": mark}, base=base)

    return apply


# catch-up before a read


def drift(stored: DataFrame, present: DataFrame, key: str = "path", hash_col: str = "hash") -> int:
    """Files that were added, deleted or changed since ``stored``."""
    a, b = stored.select(key, F.col(hash_col).alias("_was")), present.select(key, F.col(hash_col).alias("_is"))
    x = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full")
    return x.filter(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("_was").eqNullSafe(F.col("_is"))).count()


def healed(watch: Watch, n_drifted: int, same_build: bool, most: int = 20, limit_s: float = 15.0, enabled: bool = True) -> tuple[bool, str]:
    """Brings a store up to date before it is read, if few files have drifted and the build is the same: the
    pending changes are worked on for ``limit_s`` seconds at most. Gives whether it did, and why what is read
    may be stale (empty if it is not)."""
    if not same_build:
        return False, "the build has changed"
    if n_drifted == 0:
        return False, ""
    if not enabled or n_drifted > most:
        return False, f"{n_drifted} file{'' if n_drifted == 1 else 's'} changed"
    if watch.drain(limit_s=limit_s):
        return True, ""
    return False, f"{n_drifted} file{'' if n_drifted == 1 else 's'} changed, and bringing them in did not end in {limit_s:g} s"


# usage

USAGE = "ts timestamp, cmd string, outcome string, ms bigint"


def usage_rows(lines: DataFrame, column: str = "value", ddl: str = USAGE) -> DataFrame:
    """Rows of a log of JSON lines, also of a stream; lines that are no JSON object of this form, or name no
    command, are skipped."""
    x = lines.select(F.from_json(F.col(column), ddl, {"mode": "PERMISSIVE"}).alias("r"))
    return x.filter("r.cmd is not null").select("r.*")


def usage_counts(rows: DataFrame) -> DataFrame:
    """``cmd, calls, errors, total_ms, error_pct`` of each command; the same over a stream in complete mode."""
    error = F.sum(F.when(F.col("outcome") == "error", 1).otherwise(0))
    pct: Column = F.round(100 * error / F.count(F.lit(1)), 1)
    return rows.groupBy("cmd").agg(F.count(F.lit(1)).alias("calls"), error.alias("errors"), F.coalesce(F.sum("ms"), F.lit(0)).alias("total_ms"), pct.alias("error_pct"))
