"""Metrics by segment: rankings, gaps, shares and the segment-by-period matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import col, number, rounded, string_columns
from tabulyze.functions.storage import written
from tabulyze.operators.kernel import top_values
from tabulyze.operators.timeseries import span_days


def segment_sums(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """(segment, value) with NULL segments left out; an all-null segment sums to 0."""
    return (df.filter(col(segment).isNotNull()).groupBy(col(segment).alias("segment"))
            .agg(F.coalesce(F.sum(number(df, metric)), F.lit(0.0)).alias("value")))


def _with_share(sums: DataFrame) -> DataFrame:
    # a scalar subquery: the total never meets the segments in one window partition
    total = sums.agg(F.sum("value").alias("total")).scalar()
    return sums.withColumn("share_pct", rounded(F.col("value") / F.greatest(total, F.lit(1e-9)) * 100, 2))


def segment_ranking(df: DataFrame, segment: str, metric: str, top: int = 10, bottom: bool = False) -> DataFrame:
    """The largest (or, ascending, the smallest) segments by summed metric with their share."""
    return ranked_sums(segment_sums(df, segment, metric), top, bottom)


def ranked_sums(sums: DataFrame, top: int = 10, bottom: bool = False) -> DataFrame:
    """The ranking of ``segment_sums`` already gathered."""
    order = ([F.col("value").asc(), F.col("segment").desc()] if bottom
             else [F.col("value").desc(), F.col("segment").asc()])
    return _with_share(sums).orderBy(*order).limit(top)


def _averages(df: DataFrame, segment: str, metric: str) -> DataFrame:
    v = number(df, metric)
    return (df.filter(col(segment).isNotNull()).groupBy(col(segment).alias("segment"))
            .agg(F.avg(v).alias("mean"), F.count(v).alias("n"), F.stddev_samp(v).alias("std")))


def segment_stats(df: DataFrame, segment: str, metric: str, top: int = 5) -> DataFrame:
    """Mean, count and std of the best and worst segments next to the overall figures.

    The table is read once: rows without a segment are a group of their own, and the overall
    figures are put together from the groups.
    """
    v = number(df, metric)
    groups = written(df.groupBy(col(segment).alias("segment")).agg(
        F.avg(v).alias("mean"), F.count(v).alias("n"), F.stddev_samp(v).alias("std"), F.var_pop(v).alias("var")), "segments")
    whole = groups.agg(F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"),
                       F.count("segment").alias("k")).first()
    mean = F.lit(whole["mean"]).cast("double")
    spread = groups.agg(F.sum(F.col("n") * (F.col("var") + F.pow(F.col("mean") - mean, 2))).alias("s")).first()["s"]
    std = (spread / (whole["n"] - 1)) ** 0.5 if spread is not None and whole["n"] > 1 else None
    stats = groups.filter(F.col("segment").isNotNull())
    best = stats.orderBy(F.col("mean").desc_nulls_last(), "segment").limit(top).withColumn("side", F.lit("top"))
    worst = stats.orderBy(F.col("mean").asc_nulls_first(), F.col("segment").desc()).limit(top).withColumn(
        "side", F.lit("bottom"))
    return best.unionByName(worst).select(
        "side", "segment", rounded("mean", 4).alias("avg"), "n", rounded("std", 4).alias("std_dev"),
        rounded(mean, 4).alias("overall_mean"), rounded(F.lit(std).cast("double"), 4).alias("overall_std"),
        F.lit(whole["k"]).cast("long").alias("total_segments"))


def segment_gap(df: DataFrame, segment: str, metric: str, warn_above: int = 120) -> DataFrame:
    """Deviation of every segment mean from the overall mean, and the best-to-worst gap."""
    stats = _averages(df, segment, metric).select("segment", rounded("mean", 4).alias("avg"))
    overall = rounded(df.agg(F.avg(number(df, metric)).alias("m")).scalar(), 4)
    whole = stats.agg(F.struct((F.max("avg") - F.min("avg")).alias("gap"), F.count("*").alias("k")).alias("w")).scalar()
    return stats.select(
        "segment", "avg",
        rounded(F.coalesce(F.try_divide(F.col("avg") - overall, overall), F.lit(0.0)) * 100, 1).alias("deviation_pct"),
        whole["gap"].alias("gap"), whole["k"].alias("total_segments"), (whole["k"] > warn_above).alias("too_many"))


def segment_share_other(df: DataFrame, segment: str, metric: str, top: int = 10) -> DataFrame:
    """The largest segments with every other one summed as ``Other``."""
    sums = segment_sums(df, segment, metric)
    best = sums.orderBy(F.col("value").desc(), "segment").limit(top).select("segment", F.lit(True).alias("kept"))
    return (sums.join(F.broadcast(best), "segment", "left")   # at most `top` rows
            .groupBy(F.when(F.col("kept"), F.col("segment").cast("string")).otherwise("Other").alias("segment"),
                     F.coalesce("kept", F.lit(False)).alias("kept"))
            .agg(F.sum("value").alias("value")).select("segment", "value"))


def segment_concentration(df: DataFrame, segment: str, metric: str, top: int = 10) -> DataFrame:
    """One row: normalised Herfindahl index over the top shares, and the top share."""
    return concentration_of(segment_sums(df, segment, metric), top)


def concentration_of(sums: DataFrame, top: int = 10) -> DataFrame:
    """The concentration of ``segment_sums`` already gathered."""
    shares = ranked_sums(sums, top).agg(
        F.sum(F.pow(F.col("share_pct") / 100, 2)).alias("hhi"), F.count("*").alias("k"),
        F.max_by("share_pct", F.col("value")).alias("dominance"))
    floor = 1.0 / F.greatest(F.col("k"), F.lit(1))
    index = (F.col("hhi") - floor) / F.greatest(1.0 - floor, F.lit(1e-9))
    return shares.select(F.coalesce(rounded(index, 4), F.lit(0.0)).alias("concentration_risk"),
                         F.coalesce(rounded("dominance", 2), F.lit(0.0)).alias("segment_dominance"))


def top_value_share(df: DataFrame, first: int | None = None) -> DataFrame:
    """Commonest value of each text column with its share of the filled cells."""
    columns = string_columns(df)[:first]
    return top_values(df, columns).select("column", "ordinal", "top_value", "top_n",
                                          F.try_divide(F.col("top_n").cast("double"), "n").alias("top_share"))


def _period(freq: str, ts: Column) -> Column:
    """Calendar label: Monday/Sunday range of the week, or year and quarter."""
    if freq == "W":
        monday = F.date_trunc("week", ts).cast("date")
        return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def performance_matrix(df: DataFrame, segment: str, metric: str, time: str) -> DataFrame:
    """(segment, period, value): weekly sums up to a year of data, quarterly beyond."""
    rows = df.select(col(segment).alias("segment"), col(time).alias("ts"), number(df, metric).alias("v")).dropna()
    days = span_days(rows, "ts")
    freq = "W" if days is None or days <= 365 else "Q"
    return (rows.groupBy("segment", _period(freq, F.col("ts")).alias("period"))
            .agg(F.sum("v").alias("value")))


def performance_matrix_wide(df: DataFrame, segment: str, metric: str, time: str) -> DataFrame:
    """The matrix with one column per period."""
    long = performance_matrix(df, segment, metric, time)
    periods = sorted(r["period"] for r in long.select("period").distinct().collect())   # weeks of a year, or quarters
    return long.groupBy("segment").pivot("period", periods).agg(F.sum("value"))
