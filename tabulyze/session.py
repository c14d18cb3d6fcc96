"""Session settings for tests, benchmarks and stand-alone use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "tabulyze", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session. On a cluster use the cluster's own session and set
    ``spark.checkpoint.dir`` to shared storage and ``spark.sql.shuffle.partitions`` to
    two or three times the executor cores."""
    partitions = "8" if cores == "*" else str(cores)
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.shuffle.partitions", partitions)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             # capturing the call site costs several driver round trips per expression node
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
