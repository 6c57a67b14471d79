"""A table of tracks on disk that takes writes in place: only the partitions that a write touches are written anew.

Tracks lie by language and by shard, a hash of the project, so that a folder holds many projects and a write replaces a few
folders. A batch is merged with what those folders hold, the newest write of each (project, language) wins, the result is
staged beside the table and then put in place by dynamic partition overwrite. A marker for each batch makes writing it again
do nothing, so the writer gives exactly-once effects as a foreachBatch sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracklake.operators.tracks import latest_wins
from tracklake.storage import file_system

KEYS = ("project_id", "language")
LAYOUT = ("language", "shard")
SHARDS = 64


def shard_of(project: str = "project_id", shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(project), F.lit(shards)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def _has_rows(spark: SparkSession, store: str) -> bool:
    """Whether the table has any partition yet: a folder that is no marker or stage."""
    fs, at = file_system(spark, store)
    return fs.exists(at) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(at))


def read_store(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The stored tracks under their schema; filters on language reach the folders. An empty store has no rows."""
    if not _has_rows(spark, store):
        return spark.createDataFrame([], schema)
    layout = StructType([*schema.fields]).add("shard", "integer")
    return spark.read.schema(layout).parquet(store).select(*schema.fieldNames())


def write_batch(batch: DataFrame, store: str, batch_id: int, version: str = "updated_at", shards: int = SHARDS) -> bool:
    """Merge a batch (project_id, language, version, any other columns) into the store; False if it was written before.

    A track of a smaller version than the stored one is passed over. Of equal versions in the batch the greatest other columns
    win, and a batch's row wins over a stored one of its version: the outcome does not depend on the order of rows. Rows
    without a project or a language are refused. If a write fails half way, the batch is written again in full: whatever was
    put in place is merged with itself.
    """
    spark = batch.sparkSession
    marker = f"{store}/_batches/{batch_id}"
    if _exists(spark, marker):
        return False
    if batch.where(F.col("project_id").isNull() | F.col("language").isNull()).limit(1).count():
        raise ValueError("tracks need a project_id and a language")
    fresh = latest_wins(batch, list(KEYS), version).withColumn("shard", shard_of(shards=shards))
    stage = f"{store}/_stage/{batch_id}"
    touched = fresh.select(*LAYOUT).distinct()  # of as many rows as there are shards and languages at most
    fresh_rows = fresh.withColumn("_new", F.lit(1))
    if _has_rows(spark, store):
        old = spark.read.schema(fresh.schema).parquet(store).join(F.broadcast(touched), list(LAYOUT), "left_semi").withColumn("_new", F.lit(0))
        fresh_rows = fresh_rows.unionByName(old)
    rest = [c for c in fresh.columns if c not in KEYS]
    merged = fresh_rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_r")).select(*KEYS, *[F.col(f"_r.{c}").alias(c) for c in rest])
    merged.write.mode("overwrite").parquet(stage)
    staged = spark.read.schema(merged.schema).parquet(stage)
    staged.repartition(*LAYOUT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(store)
    fs, at = file_system(spark, marker)
    fs.mkdirs(at.getParent())
    fs.create(at, True).close()
    stage_fs, stage_at = file_system(spark, stage)
    stage_fs.delete(stage_at, True)
    return True


def sink(store: str, version: str = "updated_at", shards: int = SHARDS) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that merges each micro-batch into the store."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, store, batch_id, version, shards)

    return write
