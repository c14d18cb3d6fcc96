"""Looking values up in a dictionary of unknown size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000   # keys are at most 65 characters, so some 10 MB
HOT_ROWS = 1_000_000       # rows of one value that may meet in a task
SALTS = 64


def attach(df: DataFrame, lookup: DataFrame, key: str, size: float, total: int,
           weight: str = "n") -> DataFrame:
    """Left join of ``lookup`` (one row per ``key``) that no hot key can slow down.

    Up to ``BROADCAST_ROWS`` keys the dictionary is broadcast. Beyond that only
    its hot keys are (``weight`` says how many rows each has): those with more
    than ``HOT_ROWS`` rows, or than makes ``BROADCAST_ROWS`` such keys possible.
    Rows with a hot or missing key are spread over salts instead of meeting in
    one task, and the rest join by shuffle on keys that are cold by construction.
    """
    fields = [c for c in lookup.columns if c != key]
    if size <= BROADCAST_ROWS:
        return df.join(F.broadcast(lookup), key, "left")
    most = max(HOT_ROWS, total / max(BROADCAST_ROWS, 1))
    hot, cold = lookup.filter(F.col(weight) > most), lookup.filter(F.col(weight) <= most)
    hot = F.broadcast(hot.select(key, F.struct(*fields).alias("__hot")))
    tagged = df.join(hot, key, "left")
    settled = F.col("__hot").isNotNull() | F.col(key).isNull()
    tagged = tagged.withColumn("__key", F.when(~settled, F.col(key))).withColumn(
        "__salt", F.when(settled, F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    cold = cold.select(F.col(key).alias("__key"), F.lit(0).cast("long").alias("__salt"),
                       F.struct(*fields).alias("__cold"))
    joined = tagged.join(cold, ["__key", "__salt"], "left")
    found = F.coalesce("__hot", "__cold")
    return joined.select(*df.columns, *[found[f].alias(f) for f in fields])
