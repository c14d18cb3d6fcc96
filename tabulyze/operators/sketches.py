"""Distinct counts whose states can be stored and united, for tables counted day by day.

``distinct_states`` keeps a HyperLogLog state per column (and per group, say a day); states of
any groups unite without reading their rows again. The relative error of an estimate is about
``relative_error(size)``; exact counts are ``profiling.cardinality``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulyze.functions.columns import FLOAT_TYPES, compact_sql, kind, pick, quoted

SIZE = 14          # a state has 2 ** SIZE places and takes up to 2 ** SIZE bytes


def relative_error(size: int = SIZE, deviations: float = 3.0) -> float:
    """Bound of the relative error, ``deviations`` standard errors wide."""
    return deviations * 1.04 / 2 ** (size / 2)


def distinct_states(df: DataFrame, by: str | None = None, columns: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """([``by``,] column, ordinal, n_rows, n, state): one mergeable state per column, from one scan.

    Nulls, and NaN as a null, are not counted as values. A column without values has a state that counts none.
    """
    columns = [f.name for f in df.schema.fields if kind(f) != "other" and f.name != by] if columns is None else columns
    # both zeros are one value
    text = lambda c: f"{compact_sql(df, c)} + 0.0D" if isinstance(df.schema[c].dataType, FLOAT_TYPES) else compact_sql(df, c)
    cells = ", ".join(f"struct({i} as ordinal, cast({text(c)} as string) as cell)" for i, c in enumerate(columns))
    keys = ["ordinal"] if by is None else ["__by", "ordinal"]
    rows = df.selectExpr(*([] if by is None else [f"{quoted(by)} as __by"]), f"inline(array({cells}))")
    states = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count("cell").alias("n"),
                                     F.expr(f"hll_sketch_agg(cell, {size})").alias("state"))
    named = [] if by is None else [F.col("__by").alias(by)]
    return states.select(*named, pick(columns).alias("column"), "ordinal", "n_rows", "n", "state")


def united(states: DataFrame, *keys: str) -> DataFrame:
    """States of several groups as one per column, or per ``keys`` and column."""
    return states.groupBy(*keys, "column", "ordinal").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.expr("hll_union_agg(state, true)").alias("state"))


def estimated(states: DataFrame) -> DataFrame:
    """The states with ``n_distinct`` in place of the state."""
    return states.withColumn("n_distinct", F.expr("hll_sketch_estimate(state)")).drop("state")
