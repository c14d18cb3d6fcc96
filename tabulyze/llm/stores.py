"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tabulyze.functions.storage import scratch_path


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write the frame once and read it from there; later jobs do not depend on its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df if partitions is None else df.repartition(partitions)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables that no later job reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What frames made in here have shuffled is deleted when they are written, and not when
    the driver collects its garbage, which may be after the last of many steps."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
