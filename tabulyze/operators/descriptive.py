"""Descriptive statistics per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulyze.functions.columns import numeric_columns, percent, rounded
from tabulyze.operators.kernel import edge_values, numeric_profile, top_values, with_quantiles
from tabulyze.operators.quantiles import exact_quantiles


def _with_median(df: DataFrame, shape: bool = True) -> DataFrame:
    columns = numeric_columns(df)
    return with_quantiles(numeric_profile(df, columns, shape=shape),
                          exact_quantiles(df, columns, [0.5]), ["median"])


def numerical_summary(df: DataFrame) -> DataFrame:
    """count, mean, median, std, variance, min, max, skewness, kurtosis, missing %."""
    return _with_median(df).select(
        "column", F.col("n").alias("count"), "mean", "median", "std", "variance", "min", "max",
        "skewness", "kurtosis", rounded("missing_pct", 2).alias("missing_percentage"))


def categorical_summary(df: DataFrame) -> DataFrame:
    """count, distinct, commonest value with its count and share of filled cells, missing %."""
    return top_values(df).select(
        "column", F.col("n").alias("count"), F.col("n_distinct").alias("unique_count"), "top_value",
        F.col("top_n").alias("top_frequency"),
        rounded(percent(F.col("top_n"), F.col("n")), 2).alias("top_percentage"),
        rounded(percent(F.col("n_rows") - F.col("n"), F.col("n_rows")), 2).alias("missing_percentage"))


def shape_stats(df: DataFrame) -> DataFrame:
    return numeric_profile(df).select(
        "column", *[rounded(c, 4).alias(a) for c, a in
                    (("mean", "mean"), ("std", "std"), ("skewness", "skew"), ("kurtosis", "kurtosis"))])


def distribution_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Moments, 5th/50th/95th percentile and IQR outliers of columns with more than 3 values."""
    columns = numeric_columns(df) if columns is None else columns
    qs = exact_quantiles(df, columns, [0.05, 0.25, 0.5, 0.75, 0.95])
    fences = {c: None if q[0] is None else
              (q[1], q[3], q[1] - 1.5 * (q[3] - q[1]), q[3] + 1.5 * (q[3] - q[1])) for c, q in qs.items()}
    # a column without spread has no outliers
    fences = {c: f if f and f[1] > f[0] else None for c, f in fences.items()}
    profile = numeric_profile(df, columns, fences)
    profile = with_quantiles(profile, {c: [q[2], q[0], q[4]] for c, q in qs.items()},
                             ["median", "p5", "p95"])
    return profile.filter(F.col("n") > 3).select(
        "column", "ordinal", rounded("mean", 6).alias("mean"), rounded("median", 6).alias("median"),
        rounded("std", 6).alias("std"), rounded("skewness", 4).alias("skew"),
        rounded("kurtosis", 4).alias("kurtosis"), rounded("p5", 6).alias("p5"),
        rounded("p95", 6).alias("p95"), F.col("outliers").alias("outlier_count"))


def skew_ranking(df: DataFrame, columns: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Columns with more than three values by absolute skew."""
    ranked = (numeric_profile(df, columns).filter(F.col("n") > 3)
              .select("column", "ordinal", rounded("skewness", 4).alias("skew"))
              .orderBy(F.abs("skew").desc(), "ordinal"))
    return (ranked.limit(top) if top else ranked).select("column", "skew")


def variance_summary(df: DataFrame) -> DataFrame:
    return numeric_profile(df, shape=False).select("column", rounded("variance", 4).alias("variance"))


def report_descriptives(df: DataFrame) -> DataFrame:
    return _with_median(df, shape=False).select("column", "ordinal", "mean", "std", "min", "max", "median")


def kpi_by_column(df: DataFrame, order: list[str]) -> DataFrame:
    """Centre and spread per column, and the % change from the last but one filled row to the last."""
    columns = numeric_columns(df)
    last = (edge_values(df, columns, order, 2, last=True)
            .groupBy("ordinal").agg(
                F.max(F.when(F.col("rn") == 1, F.col("v").cast("double"))).alias("now"),
                F.max(F.when(F.col("rn") == 2, F.col("v").cast("double"))).alias("before")))
    return (_with_median(df, shape=False).filter(F.col("n") > 0)
            .join(F.broadcast(last), "ordinal", "left")  # one row per column
            .select("column", "ordinal", "mean", "median", "std", "min", "max",
                    ((F.try_divide("now", "before") - 1) * 100).alias("pct_change_last")))


def column_means_ranked(df: DataFrame, first: int | None = None, top: int = 10) -> DataFrame:
    """Largest means among the numeric columns, or among the ``first`` of them."""
    return (numeric_profile(df, numeric_columns(df)[:first], shape=False)
            .select("column", "ordinal", "mean").orderBy(F.col("mean").desc(), "ordinal").limit(top)
            .select("column", "mean"))
