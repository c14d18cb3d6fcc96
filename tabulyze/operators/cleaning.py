"""Imputation, de-duplication, outlier capping and the two cleaning pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulyze.functions.columns import (
    clip, col, columns_of, number, numeric_columns, rounded, side_by_side, string_columns, value)
from tabulyze.functions import lookup
from tabulyze.functions.storage import written
from tabulyze.operators import profiling
from tabulyze.operators.kernel import null_counts, row_counts, row_fingerprint_sql, top_values
from tabulyze.operators.quantiles import exact_quantiles, iqr_fences
from tabulyze.operators.typing import promote_majority, promote_strict


def _gaps(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least one missing cell."""
    if not columns:
        return []
    rows = null_counts(df, columns).filter(F.col("n") < F.col("n_rows")).collect()   # one row per column
    return [c for c in columns if c in {r["column"] for r in rows}]


def _filled(df: DataFrame, numbers: dict[str, float | None], texts: dict[str, str | None]) -> DataFrame:
    def cell(c):
        if numbers.get(c) is not None:
            return F.coalesce(number(df, c), F.lit(float(numbers[c]))).alias(c)
        if texts.get(c) is not None:
            return F.coalesce(value(df, c), F.lit(texts[c]).cast(df.schema[c].dataType)).alias(c)
        return value(df, c).alias(c)
    return df.select(*[cell(c) for c in df.columns])


def _medians(df: DataFrame) -> dict[str, float | None]:
    gaps = _gaps(df, numeric_columns(df))
    return {c: q[0] for c, q in exact_quantiles(df, gaps, [0.5]).items()}


def impute_median_unknown(df: DataFrame, strategy: str = "auto") -> DataFrame:
    """Numeric gaps take the median, text gaps ``Unknown``; other types stay."""
    if strategy != "auto":
        raise ValueError(f"strategy {strategy!r} is not built: gaps are filled by 'auto' only")
    return _filled(df, _medians(df), {c: "Unknown" for c in string_columns(df)})


def impute_median_mode(df: DataFrame) -> DataFrame:
    """Numeric gaps take the median, categorical gaps the commonest value (smallest on a tie)."""
    gaps = _gaps(df, columns_of(df, "string", "boolean"))
    modes = {r["column"]: r["top_value"] for r in top_values(df, gaps).collect()} if gaps else {}
    return _filled(df, _medians(df), modes)


def _distinct(df: DataFrame) -> DataFrame:
    return df.select(*[value(df, c).alias(c) for c in df.columns]).dropDuplicates()


def dedupe(df: DataFrame) -> DataFrame:
    """Distinct rows; nulls compare equal, and NaN is a null.

    Fingerprints find the rows that occur more than once, so 16 bytes a row are shuffled. While
    these rows' fingerprints are few, all others pass as they are and only the repeated rows meet;
    beyond that all rows meet in a shuffle whose map side drops what repeats within a task.
    """
    cells = [value(df, c).alias(c) for c in df.columns]
    hashes = [F.expr(h).alias(f"__h{i}") for i, h in enumerate(row_fingerprint_sql(df), 1)]
    repeated = df.select(*hashes).groupBy("__h1", "__h2").agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    repeated = written(repeated, "repeated_rows")
    many = repeated.count()
    if many == 0:
        return df.select(*cells)
    if many > lookup.BROADCAST_ROWS:
        return _distinct(df)
    # rows are hashed as they were given, before NaN becomes a null
    rows = df.select(*cells, *hashes)
    once = rows.join(F.broadcast(repeated), ["__h1", "__h2"], "left_anti").select(*map(col, df.columns))
    again = rows.join(F.broadcast(repeated), ["__h1", "__h2"], "left_semi").select(*map(col, df.columns))
    return once.unionAll(again.dropDuplicates())


def cap_outliers(df: DataFrame, iqr_multiplier: float = 1.5) -> DataFrame:
    """Clamp numeric columns with a spread to their IQR fences."""
    columns = numeric_columns(df)
    counts = {r["column"]: r["n"] for r in null_counts(df, columns).collect()} if columns else {}   # one row per column
    fences = iqr_fences(df, columns, iqr_multiplier, sizes=counts)
    def cell(c):
        f = fences.get(c)
        if f and f[1] - f[0] > 0 and counts[c] >= 4:
            return clip(number(df, c), F.lit(f[2]), F.lit(f[3])).alias(c)
        return col(c)
    return df.select(*[cell(c) for c in df.columns])


def cleaning_dry_run(df: DataFrame) -> DataFrame:
    """One row: what the strict pipeline's steps would change, each on the table as given."""
    return side_by_side(
        row_counts(df).select(F.col("n_rows").alias("rows_before"),
                              F.col("distinct_rows").alias("rows_after_duplicates_removed")),
        profiling.missing_cells(df).select(F.col("missing_cells").alias("missing_values_to_fill")),
        profiling.outlier_cells(df).select(F.col("outliers_spread").alias("outlier_values_to_cap")))


def clean_strict(df: DataFrame) -> DataFrame:
    """Promote types, impute, drop duplicates, cap outliers.

    The de-duplicated rows are written once: the fences and the result both read them. They
    come out of parsing and imputing, which finding fingerprints first would do twice, so they
    meet whole.
    """
    return cap_outliers(written(_distinct(impute_median_unknown(promote_strict(df))), "distinct_rows"))


def clean_app(df: DataFrame) -> DataFrame:
    """Drop duplicates, promote types by majority, impute with median and mode."""
    return impute_median_mode(promote_majority(written(dedupe(df), "distinct_rows")))


def quality_before_after(df: DataFrame) -> DataFrame:
    """Quality metrics before and after ``clean_app`` with the change and its direction."""
    lower = {"missing_pct": True, "duplicate_pct": True, "outlier_pct": True, "quality_score": False}
    def long(frame, name):
        return profiling.quality_score_app(frame).select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias(name), F.lit(better).alias("lower_is_better"))
            for m, better in lower.items()])))
    after = long(written(clean_app(df), "clean_rows"), "after").drop("lower_is_better")
    delta = rounded(F.col("after") - F.col("before"), 2)
    return (long(df, "before").join(F.broadcast(after), "metric")   # four rows
            .select("metric", "before", "after", delta.alias("delta"),
                    F.when(F.abs(delta) < 0.005, "no change")
                    .when((delta < 0) == F.col("lower_is_better"), "improved").otherwise("worse").alias("verdict")))
