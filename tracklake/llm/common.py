"""Helpers shared by the corpus operators: reading tables, cutting lineage, small column idioms."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java and RE2 character class.
WS = r"[\x20\x09-\x0D]"
#: Rows of one Arrow batch: whole texts can be long, so batches stay small.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark's reader touches the path, so it may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where all run in one process, as in tests, may it be unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())  # paths made in the open scratch blocks of this thread


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed when the session's file system closes, or a scratch block ends."""
    path = f"{shared_dir(spark)}/tracklake/{uuid.uuid4().hex}"
    fs, hadoop_path = _on_disk(spark, path)
    fs.deleteOnExit(hadoop_path)
    if _made.get():
        _made.get()[-1].append(path)
    return path


def _on_disk(spark: SparkSession, path: str) -> tuple:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written by operators inside the block go at its end: what it gives must have been written elsewhere by then."""
    paths: list[str] = []
    token = _made.set((*_made.get(), paths))
    try:
        yield
    finally:
        _made.reset(token)
        for path in paths:
            fs, hadoop_path = _on_disk(spark, path)
            fs.delete(hadoop_path, True)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: later steps survive lost executors without recomputing."""
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_order() -> list[Column]:
    """Place of each row of a table that was written in order and read again: the number that Spark gave its file, its place there."""
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small. The setting belongs to the session: it is read when a plan runs, so it stays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is not inlined as an alias would be."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words(text: Column) -> Column:
    """The words of a text; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+", -1), "")
