"""Row order without a single-partition window.

A running computation over one long ordered series is cut into blocks of
consecutive rows. Each block also gets the last rows of the block before it (its
halo), so windows that look back at most ``halo`` rows stay inside a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulyze.functions.storage import materialise

_LOW_BITS = (1 << 33) - 1


def indexed(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx``, the zero-based position by ``order`` (which must be unique).

    Rows are range-sorted once and written to shared storage, so the positions
    cannot change if a task is run again. Only one count per partition is
    gathered and sent back.
    """
    ranged = materialise(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33).cast("int")
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["__part"]):
        starts.append((row["__part"], total))
        total += row["n"]
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    return (ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part")   # one row per partition
            .withColumn("idx", F.col("__start") + F.col("__m").bitwiseAND(F.lit(_LOW_BITS)))
            .drop("__part", "__start", "__m"))


def in_blocks(df: DataFrame, rows: int, halo: int) -> DataFrame:
    """Add ``blk`` and ``is_halo`` to an ``indexed`` frame; halo rows appear twice."""
    if halo >= rows:
        raise ValueError("a block must be longer than its halo")
    own = F.expr(f"idx div {rows}")
    here = F.struct(own.alias("blk"), F.lit(False).alias("is_halo"))
    ahead = F.struct((own + 1).alias("blk"), F.lit(True).alias("is_halo"))
    spots = F.when(F.col("idx") % rows >= rows - halo, F.array(here, ahead)).otherwise(F.array(here))
    return df.select("*", F.inline(spots))
