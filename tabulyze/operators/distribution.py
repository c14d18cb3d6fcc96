"""Histograms, density curves, frequencies and per-column diagnostics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import (
    col, datetime_columns, is_integer, number, numeric_columns, percent, rounded, string_columns)
from tabulyze.operators.kernel import null_counts, numeric_profile, top_values, with_quantiles
from tabulyze.operators.quantiles import exact_quantiles, iqr_fences


def _ends(df: DataFrame, name: str):
    v = number(df, name)
    return df.agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).first()


def auto_bins(n: int, low: float, high: float, q1: float, q3: float, whole: bool) -> int:
    """Bin count of the narrower of the Sturges and Freedman-Diaconis widths."""
    if n == 0 or high == low:
        return 1
    sturges = (high - low) / (math.log2(n) + 1.0)
    width = min(2.0 * (q3 - q1) / n ** (1.0 / 3.0), sturges) if q3 > q1 else sturges
    if whole:
        width = max(width, 1.0)
    return max(int(math.ceil((high - low) / width)), 1)


def histogram(df: DataFrame, name: str, bins: int | None = None, markers: bool = False) -> DataFrame:
    """Equal-width bins with edges, mid-point and count; empty bins are kept.

    ``bins=None`` chooses the number of bins from the data. ``markers`` adds mean and median.
    """
    ends = _ends(df, name)
    if ends["n"] == 0:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, mid double, count long")
    low, high = ends["low"], ends["high"]
    if bins is None:
        q1, q3 = exact_quantiles(df, [name], [0.25, 0.75])[name]
        bins = auto_bins(ends["n"], low, high, q1, q3, is_integer(df, name))
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    edge = lambda i: F.lit(low) + i * F.lit(step)
    v = number(df, name)
    guess = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))
    # rounding may put a value next to the bin whose edges hold it
    guess = guess - F.when(v < edge(guess), 1).otherwise(0)
    place = guess + F.when((v >= edge(guess + 1)) & (guess < bins - 1), 1).otherwise(0)
    counts = df.filter(v.isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("count"))
    spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    right = F.when(F.col("bin") == bins - 1, F.lit(high)).otherwise(edge(F.col("bin") + 1))
    out = (spine.join(counts, "bin", "left")
           .select("bin", edge(F.col("bin")).alias("low"), right.alias("high"),
                   ((edge(F.col("bin")) + right) / 2).alias("mid"), F.coalesce("count", F.lit(0)).alias("count")))
    if markers:
        median = exact_quantiles(df, [name], [0.5])[name][0]
        out = out.withColumn("mean", df.agg(F.avg(v).alias("m")).scalar()).withColumn("median", F.lit(median))
    return out


def kde_curve(df: DataFrame, name: str, bins: int = 35, points: int = 200, min_rows: int = 11) -> DataFrame:
    """Gaussian density (Scott bandwidth) on an even grid, scaled to histogram counts.

    Every value weighs on every grid point: a task adds its Arrow batches up to one row of
    sums per point. Fewer than ``min_rows`` values, or no spread, give no curve.
    """
    v = number(df, name)
    stats = df.agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"),
                   F.stddev_samp(v).alias("std")).first()
    n, low, high = stats["n"], stats["low"], stats["high"]
    if n < min_rows or not stats["std"] or not math.isfinite(stats["std"]):
        return df.sparkSession.createDataFrame([], "point int, x double, y double")
    h = stats["std"] * n ** -0.2
    step = (high - low) / (points - 1)
    scale = (high - low) / bins / (h * math.sqrt(2 * math.pi))
    grid = low + np.arange(points) * step

    def weights(batches):
        total = np.zeros(points)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for first in range(0, len(x), 4096):
                total += np.exp(-0.5 * ((grid[:, None] - x[None, first:first + 4096]) / h) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(points, dtype=np.int32)), pa.array(total)], ["point", "weight"])

    sums = df.filter(v.isNotNull()).select(v.alias("v")).mapInArrow(weights, "point int, weight double")
    return sums.groupBy("point").agg(F.sum("weight").alias("w")).select(
        "point", (F.lit(low) + F.col("point") * F.lit(step)).alias("x"), (F.col("w") * scale).alias("y"))


def frequency_table(df: DataFrame, name: str) -> DataFrame:
    """Count per value, NULL included, most frequent first."""
    return df.groupBy(col(name).alias("value")).agg(F.count("*").alias("count")).orderBy(
        F.col("count").desc(), F.col("value").asc_nulls_last())


def box_stats(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Quartiles, fences, mean and sd of the numeric columns, or of the first ``cap``."""
    columns = numeric_columns(df)[:cap]
    qs = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    out = with_quantiles(numeric_profile(df, columns, shape=False), qs, ["q1", "median", "q3"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return out.filter(F.col("n") > 0).select(
        "column", "q1", "median", "q3", (F.col("q1") - reach).alias("lower_fence"),
        (F.col("q3") + reach).alias("upper_fence"), "min", "max", "mean", "std")


def distribution_class(skew: Column) -> Column:
    size, side = F.abs(skew), F.when(skew > 0, "right").otherwise("left")
    return (F.when(size > 2, F.concat(F.lit("Highly skewed ("), side, F.lit(")")))
            .when(size > 1, F.concat(F.lit("Moderately skewed ("), side, F.lit(")")))
            .when(size > 0.5, "Slightly skewed").otherwise("Approximately normal"))


def outlier_risk(pct: Column) -> Column:
    return F.when(pct > 5, "High").when(pct >= 1, "Moderate").otherwise("Low")


def skew_risk(skew: Column) -> Column:
    return F.when(F.abs(skew) > 1, "High").when(F.abs(skew) > 0.5, "Moderate").otherwise("Low")


def _skews(df: DataFrame) -> DataFrame:
    return numeric_profile(df, numeric_columns(df)).select("column", "ordinal", _skew().alias("skew"))


def _skew() -> Column:
    return F.coalesce(F.when(F.col("n") > 2, F.col("skewness")), F.lit(0.0))


def _numeric_diagnostics(df: DataFrame) -> DataFrame:
    columns = numeric_columns(df)
    profile = numeric_profile(df, columns, iqr_fences(df, columns))
    return profile.select(
        "column", "ordinal", _skew().alias("skew"),
        F.when(F.col("n") < 4, 0.0).otherwise(percent(F.col("outliers"), F.col("n"))).alias("pct"), "missing_pct")


def distribution_classes(df: DataFrame) -> DataFrame:
    return _skews(df).select("column", distribution_class(F.col("skew")).alias("distribution"))


def risk_classes(df: DataFrame) -> DataFrame:
    return _numeric_diagnostics(df).select("column", outlier_risk(F.col("pct")).alias("outlier_risk"),
                                           skew_risk(F.col("skew")).alias("skew_risk"))


def column_diagnostics(df: DataFrame) -> DataFrame:
    """One row per numeric, text and datetime column with the facts of its kind."""
    frames = []
    if numeric_columns(df):
        frames.append(_numeric_diagnostics(df).select(
            "column", F.lit("numeric").alias("dtype"), rounded("skew", 4).alias("skewness"),
            rounded("pct", 2).alias("outlier_pct"), distribution_class(F.col("skew")).alias("distribution"),
            rounded("missing_pct", 2).alias("missing_pct"), outlier_risk(F.col("pct")).alias("outlier_risk"),
            skew_risk(F.col("skew")).alias("skew_risk")))
    if string_columns(df):
        frames.append(top_values(df, include_null=True).select(
            "column", F.lit("categorical").alias("dtype"), F.col("n_distinct").alias("cardinality"),
            rounded(percent(F.col("top_n"), F.col("n_rows")), 2).alias("dominance_pct"),
            rounded(percent(F.col("n_rows") - F.col("n"), F.col("n_rows")), 2).alias("missing_pct")))
    if datetime_columns(df):
        frames.append(null_counts(df, datetime_columns(df)).select(
            "column", F.lit("datetime").alias("dtype"),
            rounded(percent(F.col("n_rows") - F.col("n"), F.col("n_rows")), 2).alias("missing_pct")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    for name, dtype in (("skewness", "double"), ("outlier_pct", "double"), ("distribution", "string"),
                        ("outlier_risk", "string"), ("skew_risk", "string"), ("cardinality", "long"),
                        ("dominance_pct", "double")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(dtype))
    return out


def column_diagnostic(df: DataFrame, name: str) -> DataFrame:
    """The diagnostics of one column, read alone."""
    return column_diagnostics(df.select(col(name)))


def most_skewed(df: DataFrame) -> DataFrame:
    return (_skews(df).select("column", "ordinal", rounded("skew", 4).alias("skewness"))
            .orderBy(F.abs("skewness").desc(), "ordinal").limit(1).select("column", "skewness"))


def top_risk_columns(df: DataFrame, top: int = 3) -> DataFrame:
    rank = lambda c: F.when(c == "High", 2).when(c == "Moderate", 1).otherwise(0)
    risk = _numeric_diagnostics(df).select(
        "column", "ordinal", outlier_risk(F.col("pct")).alias("outlier_risk"), skew_risk(F.col("skew")).alias("skew_risk"))
    risk = risk.withColumn("risk_rank", rank(F.col("outlier_risk")) + rank(F.col("skew_risk")))
    return risk.orderBy(F.col("risk_rank").desc(), "ordinal").limit(top).drop("ordinal")
