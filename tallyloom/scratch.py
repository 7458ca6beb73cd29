"""Durable intermediate tables.

A plan that is read more than once, or whose partition numbers carry meaning,
is written to the folder the cluster shares, so a lost executor costs a re-read
and never a recomputation with different partition bounds.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root, grouped by application for easy clean-up."""
    return f"{scratch_root(spark)}/tallyloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` once and read it back with the same schema."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def finished_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers N of the folders batch=N that carry the mark of a completed write."""
    files, path = _hadoop(spark, folder)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    batches = [name for name in names if name.startswith("batch=")]
    return [int(name[len("batch="):]) for name in batches if files.exists(_hadoop(spark, f"{folder}/{name}/_SUCCESS")[1])]


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    files, path = _hadoop(spark, folder)
    return [status.getPath().getName() for status in files.listStatus(path) if status.isDirectory()] if files.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    files, path = _hadoop(spark, folder)
    files.delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and no plan reads any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            remove(table.sparkSession, files[0].rpartition("/")[0])


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs be deleted. Spark's cleaner does so once the driver's garbage is collected, which a
    driver with little to do may put off for long; call it between the phases of a job that writes much more than it keeps."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete the tables this application wrote below the scratch root. Frames read from them become unusable."""
    files, path = _hadoop(spark, f"{scratch_root(spark)}/tallyloom-{spark.sparkContext.applicationId}")
    files.delete(path, True)
