"""Tables that lie by medium: rows of a medium in one bucket, in order, so that reading them needs no exchange.

Interval chains and joins on media_id over such tables run in place. A medium is then one task's work: where few media hold
most rows, read the tables plainly, so that joins spread a medium over its time bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def write_by_medium(df: DataFrame, table: str, buckets: int, path: str | None = None, order: tuple[str, ...] = ("start_ms",)) -> None:
    """Write df as a bucketed table, one file a bucket. Tables that are joined need the same number of buckets.

    Choose it so that a bucket fits into a task: rows of all media over buckets. An existing table is replaced.
    """
    writer = df.repartition(buckets, "media_id").write.mode("overwrite").format("parquet").bucketBy(buckets, "media_id").sortBy("media_id", *order)
    (writer.option("path", path) if path else writer).saveAsTable(table)


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Within it, joins on media_id and further keys use the buckets as they lie: plan and run the query inside."""
    before = spark.conf.get(ALL_KEYS, "true")
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)
