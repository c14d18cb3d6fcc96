"""How much data each operator needs, as a frame: a refusal is a row, not an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulyze.functions.columns import columns_of, datetime_columns, numeric_columns, pick
from tabulyze.operators.kernel import null_counts

# Filled cells a number column needs, and rows the table needs.
COLUMN_GATES = {"iqr_outliers": 4, "distribution": 4, "anomalies": 11, "time_trend": 5}
TABLE_GATES = {"forecast": 6, "time_series_model": 30, "regression_model": 50, "classification_model": 50, "clustering_model": 50}
# what a table needs besides rows: numbers of (numeric, text, datetime) columns
TABLE_COLUMNS = {"forecast": (1, 0, 0), "time_series_model": (0, 0, 1), "regression_model": (1, 0, 0),
                 "classification_model": (1, 1, 0), "clustering_model": (2, 0, 0)}


def dataset_gates(df: DataFrame) -> DataFrame:
    """(operator, column, needed, found, lacking, passes): one row per operator and number column, or
    per operator on the whole table, from one scan of counters.

    ``lacking`` names the kinds of column a table-wide operator misses, null where it has all.
    A table without number columns has table-wide rows only; an empty table passes nothing.
    """
    counts = null_counts(df)
    total = counts.agg(F.max("n_rows").alias("found"))
    have = (len(numeric_columns(df)), len(columns_of(df, "string", "other")), len(datetime_columns(df)))
    kinds = ("numeric", "text", "datetime")

    def lacking(operator):
        missing = [f"{kind} columns" for kind, want, got in zip(kinds, TABLE_COLUMNS[operator], have) if got < want]
        return F.lit(", ".join(missing) if missing else None).cast("string")
    table = total.select("found", F.inline(F.array(*[
        F.struct(F.lit(o).alias("operator"), F.lit(n).alias("needed"), lacking(o).alias("lacking")) for o, n in TABLE_GATES.items()])))
    out = table.withColumn("column", F.lit(None).cast("string"))
    numeric = numeric_columns(df)
    if numeric:
        is_number = pick([c in numeric for c in df.columns])
        cells = counts.filter(is_number).select("column", F.col("n").alias("found"), F.inline(F.array(*[
            F.struct(F.lit(o).alias("operator"), F.lit(n).alias("needed")) for o, n in COLUMN_GATES.items()])))
        out = cells.withColumn("lacking", F.lit(None).cast("string")).unionByName(out)
    return out.select("operator", "column", F.col("needed").cast("long").alias("needed"), F.coalesce("found", F.lit(0)).alias("found"), "lacking",
                      ((F.coalesce("found", F.lit(0)) >= F.col("needed")) & F.col("lacking").isNull()).alias("passes"))


def series_gates(frame: DataFrame, needed: int = TABLE_GATES["forecast"]) -> DataFrame:
    """(series, needed, found, passes) of every series of a forecast frame."""
    sizes = frame.filter(~F.col("is_halo")).groupBy("series").agg(F.count("*").alias("found"))
    return sizes.select("series", F.lit(needed).cast("long").alias("needed"), "found", (F.col("found") >= needed).alias("passes"))


def with_refusals(result: DataFrame, gates: DataFrame) -> DataFrame:
    """The result of an operator per series, joined by a row for each series its gate refuses:
    ``available`` is false there, ``refusal`` says what was needed and found, the rest is null."""
    kept = result.join(gates.filter("passes").select("series"), "series", "left_semi")
    refused = gates.filter(~F.col("passes")).select("series", F.format_string("needs %d rows, has %d", "needed", "found").alias("refusal"))
    said = kept.withColumn("available", F.lit(True)).withColumn("refusal", F.lit(None).cast("string"))
    return said.unionByName(refused.withColumn("available", F.lit(False)), allowMissingColumns=True)
