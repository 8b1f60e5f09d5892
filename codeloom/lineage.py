"""Cutting the lineage of iterative plans through the reliable checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Makes sure that a shared folder is set. It is read from ``spark.checkpoint.dir``; only a local
    run without one gets a temporary folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codeloom-")
    spark.sparkContext.setCheckpointDir(found)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed now and read from a reliable checkpoint from then on."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files (and, if it is set to, the checkpoints) of what nothing refers to any more; it
    waits for the driver's garbage otherwise."""
    gc.collect()
    spark._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, for what a query keeps while it runs; it goes at the end
    of the application."""
    use_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return at
