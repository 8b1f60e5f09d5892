"""What the operators of this subpackage share: the shared folder, stashed tables, Arrow mapping."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a mapped function sees at once; bounds the memory of a Python worker.
ROWS = 500
#: Folders that this application has made.
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is
    unset, a local run (tests) sets a temporary one; a cluster raises, as no local folder would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is put there goes at the end of the application."""
    _PATHS.append(f"{shared_dir(spark)}/codeloom/{uuid.uuid4().hex}")
    fs, p = _folder(spark, _PATHS[-1])
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{_PATHS[-1]}/{name}"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Arrow batches hold at most so many rows: it bounds what a task's JVM and Python sides
    hold beside each other where rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stash(df: DataFrame, name: str, rows: int = ROWS) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts the lineage and survives lost
    executors. ``df`` is computed once, now, with at most ``rows`` rows in an Arrow batch."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with arrow_rows(spark, rows):
        df.write.parquet(path)
    return _placed(spark.read.schema(df.schema).parquet(path), path)


def _placed(df: DataFrame, path: str) -> DataFrame:
    df.__dict__["_stashed_at"] = path
    return df


def columns_of(stashed: DataFrame, *names: str) -> DataFrame:
    """Some columns of a stashed table, which can still be discarded."""
    return _placed(stashed.select(*names), stashed.__dict__["_stashed_at"])


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their place 1..N (long) in an order. Rows are dealt to ranges of the order and stashed, so
    that ranges stay as they are if an executor is lost; a row's place is that in its range after the sizes
    of the ranges before it, of which there is one row each."""
    dealt = stash(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    return dealt.withColumn("_place", place).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def release(spark: SparkSession) -> None:
    """Deletes everything that this application has put into the shared folder through here. For the
    end of a job, when no DataFrame of an operator will be read again; else it goes at the end of the
    application."""
    while _PATHS:
        fs, p = _folder(spark, _PATHS.pop())
        fs.delete(p, True)


def discard(*stashed: DataFrame) -> None:
    """Deletes stashed tables that nothing will read again."""
    for df in stashed:
        fs, p = _folder(df.sparkSession, df.__dict__["_stashed_at"])
        fs.delete(p, True)


def parts_for(rows: DataFrame, col: str, mb: int, most: int = 50_000) -> int:
    """Partitions of about ``mb`` MB of a string column, by its counted bytes, however ``rows`` came about;
    beyond ``most`` they get larger."""
    size = rows.agg(F.sum(F.octet_length(col))).first()[0] or 0
    return int(max(1, min(-(-size // (mb << 20)), most)))


class Store(dict):
    """What ``make`` gives for each key, kept in two generations of at most ``limit`` bytes each. When the
    young one is full it becomes the old one, and what is asked for again moves over. It bounds memory
    alone: results do not depend on it. What is large beside the limit is not kept."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.held, self.old = make, limit, 0, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        size = sys.getsizeof(key) + sys.getsizeof(out) + 100
        if 16 * size > self.limit:
            return out
        if self.held + size > self.limit:
            self.old, self.held = self.copy(), 0
            self.clear()
        self.held += size
        self[key] = out
        return out

    def drop(self) -> None:
        self.clear()
        self.old, self.held = {}, 0


_HOLDER: list = [None]


def claim(holder) -> None:
    """Only one holder of stores keeps them in a Python worker: the one before lets go of its own, so the
    stages of a job, which share their workers, do not add up."""
    if _HOLDER[0] is not holder:
        if _HOLDER[0] is not None:
            _HOLDER[0].drop()
        _HOLDER[0] = holder


def map_rows(df: DataFrame, schema: str, fn: Callable[..., dict], rows: int = ROWS) -> DataFrame:
    """``fn`` takes the columns of a slice of rows as lists and gives the output columns by name."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                cols = [c.to_pylist() for c in batch.slice(at, rows).columns]
                got = fn(*cols)
                yield pa.RecordBatch.from_arrays([got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)
