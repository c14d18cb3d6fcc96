"""Shared storage: cutting lineage and scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only local mode may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tabulyze-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for every call."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared checkpoint folder and read it from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write the frame once, as Parquet, and read it from there.

    Later steps neither repeat its work nor depend on its lineage, and read only the columns
    they need. ``discard`` deletes it; what is not discarded goes when the driver ends.
    """
    if any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema.fields):
        return materialise(df)
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # names that Parquet does not take, or that differ in case only, stay outside
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out.written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written frames that no later step reads."""
    for df in frames:
        if hasattr(df, "written_at"):
            where, files = _file_system(df.sparkSession, df.written_at)
            files.delete(where, True)
