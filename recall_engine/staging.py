"""Durable intermediate results in the shared folder of the cluster.

A plan that must see exactly the same rows twice (sorted ranges with their own offsets, an iterative
fold, the rows of a training) is cut here by a written table. A lost executor then costs a re-read and
never a different sampling of the range bounds.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for durable data: ``spark.checkpoint.dir``.

    On a single machine without that setting, one folder is made per session, put into the setting, and removed
    when the application ends; a cluster has to name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="recall-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/recall/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", path: str | None = None, folders: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as parquet and read it back: the hand-over between the steps of a plan.

    Readers prune columns and push filters; rows go to a folder per value of ``folders`` (few values), so that a filter on them
    reads nothing else. Staged tables stay until the folder is cleaned.
    """
    spark = df.sparkSession
    target = path or new_path(spark, label)
    df.write.mode("overwrite").partitionBy(*folders).parquet(target)
    staged = spark.read.schema(df.schema).parquet(target)
    return staged.select(*df.columns) if folders else staged


def drop(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
