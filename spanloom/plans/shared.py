"""The folder that the driver and all executors share, and small tables over idle cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables: the cluster's spark.checkpoint.dir.

    A folder of our own is made only on a local master; a cluster that names none raises, since its
    executors would each write to their own disk.
    """
    context = spark.sparkContext
    held = context._jsc.sc()
    if not held.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanloom-checkpoint-"))
    return held.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably in the shared checkpoint folder and cut its lineage.

    Lost executors cost nothing, as the files are on the shared folder. Spark deletes them when the
    table is no longer referenced if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in that folder."""
    return f"{ensure_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, wherever Spark's file systems keep it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the cluster has cores, dealt over all of them; larger ones are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
