"""The folder that driver and executors share, for tables that cut a plan or hold a stage's rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where all runs in one process, as in tests, may it be unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed when the session's file system closes."""
    path = f"{shared_dir(spark)}/tracklake/{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
