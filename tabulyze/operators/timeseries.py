"""Calendar resampling, trends and rolling counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulyze.functions.columns import col, number, numeric_columns, rounded
from tabulyze.functions.ordering import in_blocks, indexed
from tabulyze.functions.storage import written
from tabulyze.operators.kernel import edge_values

WINDOW_ROWS = 100_000     # longest ordered series left in one window partition
BLOCK_ROWS = 50_000


def span_days(df: DataFrame, ts: str) -> int | None:
    """Whole 24-hour days between the first and last timestamp."""
    ends = df.agg(F.min(ts).alias("low"), F.max(ts).alias("high")).first()
    return None if ends["low"] is None else (ends["high"] - ends["low"]).days


def period_end(freq: str, ts: Column) -> Column:
    """Label of the calendar period: the day, its Sunday, or its month end."""
    if freq == "D":
        return ts.cast("date")
    if freq == "W":
        return F.date_add(F.date_trunc("week", ts).cast("date"), 6)
    return F.last_day(ts.cast("date"))


def choose_freq(days: int) -> str:
    return "D" if days <= 90 else "W" if days <= 730 else "ME"


def _spine(sums: DataFrame, freq: str) -> DataFrame:
    """Every period between the first and the last one."""
    ends = sums.agg(F.min("period").alias("low"), F.max("period").alias("high"))
    if freq == "ME":
        days = F.transform(F.sequence(F.trunc("low", "month"), F.trunc("high", "month"), F.expr("interval 1 month")),
                           F.last_day)
    else:
        days = F.sequence("low", "high", F.expr(f"interval {1 if freq == 'D' else 7} day"))
    return ends.filter(F.col("low").isNotNull()).select(F.explode(days).alias("period"))


def time_trend(df: DataFrame, time: str, metric: str, min_rows: int = 5, freq: str | None = None) -> DataFrame:
    """(period, value, rolling_avg, freq): sums per day (D), week (W) or month (ME), by default by the span of the data.

    Empty periods sum to 0. Fewer than ``min_rows`` complete rows give no trend.
    """
    rows = df.select(col(time).alias("ts"), number(df, metric).alias("v")).dropna()
    days = rows.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.sum("v").alias("value"), F.count("v").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    return trend_of_days(written(days, "days"), min_rows, freq)


def trend_of_days(days: DataFrame, min_rows: int = 5, freq: str | None = None) -> DataFrame:
    """The trend from (day, value, n, low, high), one row per calendar day: the table behind it was
    read once, whatever period the span asks for."""
    facts = days.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if (facts["n"] or 0) < min_rows:
        return days.sparkSession.createDataFrame([], "period date, value double, rolling_avg double, freq string")
    freq = freq or choose_freq((facts["high"] - facts["low"]).days)
    sums = days.groupBy(period_end(freq, F.col("day")).alias("period")).agg(F.sum("value").alias("value"))
    full = _spine(sums, freq).join(sums, "period", "left").select(
        "period", F.coalesce("value", F.lit(0.0)).alias("value"))
    # one row per calendar period from here on
    recent = Window.partitionBy(F.lit(0)).orderBy("period").rowsBetween(-2, 0)
    return full.select("period", "value", rounded(F.avg("value").over(recent), 4).alias("rolling_avg"),
                       F.lit(freq).alias("freq"))


def trend_direction(trend: DataFrame) -> DataFrame:
    """One row: first and last value, % change and up / down / flat."""
    ends = trend.agg(F.min_by("value", "period").alias("first_value"), F.max_by("value", "period").alias("last_value"),
                     F.count("*").alias("periods"), F.max("freq").alias("freq"))
    change = rounded((F.col("last_value") - F.col("first_value"))
                     / F.greatest(F.abs("first_value"), F.lit(1e-9)) * 100, 2)
    return (ends.filter(F.col("periods") > 0).withColumn("pct_change", change)
            .withColumn("direction", F.when(F.col("pct_change") > 2, "up")
                        .when(F.col("pct_change") < -2, "down").otherwise("flat")))


def period_means(df: DataFrame, time: str, metric: str, freq: str = "ME") -> DataFrame:
    """(i, period, value): mean per non-empty calendar period, numbered in order."""
    rows = df.select(col(time).alias("ts"), number(df, metric).alias("v")).dropna()
    means = rows.groupBy(period_end(freq, F.col("ts")).alias("period")).agg(F.avg("v").alias("value"))
    # one row per calendar period
    return means.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("period")) - 1)


def trend_stats(df: DataFrame, time: str, metric: str, freq: str = "ME") -> DataFrame:
    """One row: slope per period, total change, peak, trough, ends; empty below two periods."""
    means = period_means(df, time, metric, freq)
    out = means.agg(
        F.count("*").alias("periods_analysed"), F.coalesce(F.regr_slope("value", "i"), F.lit(0.0)).alias("slope"),
        F.min_by("value", "i").alias("first"), F.max_by("value", "i").alias("last"),
        F.max_by("period", F.struct("value", -F.col("i"))).alias("peak_period"),
        F.min_by("period", F.struct("value", "i")).alias("trough_period"))
    change = F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.abs("first")), F.lit(0.0)) * 100
    return out.filter(F.col("periods_analysed") >= 2).select(
        "periods_analysed", rounded("slope", 6).alias("trend_slope"),
        F.when(F.col("slope") > 0, "upward").otherwise("downward").alias("trend_direction"),
        rounded(change, 2).alias("total_pct_change"), "peak_period", "trough_period",
        rounded("first", 4).alias("first_value"), rounded("last", 4).alias("last_value"))


def trend_recent(df: DataFrame, time: str, metric: str, freq: str = "ME", last: int = 12) -> DataFrame:
    return (period_means(df, time, metric, freq).orderBy(F.col("period").desc()).limit(last)
            .select("period", rounded("value", 4).alias("value")))


def event_counts_rolling(df: DataFrame, time: str, window: int = 7, window_rows: int | None = None,
                         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows per distinct timestamp with the mean over the last ``window`` timestamps.

    A long series is cut into blocks with a halo; a short one is a plain window.
    """
    limit = WINDOW_ROWS if window_rows is None else window_rows
    counts = (df.filter(col(time).isNotNull()).groupBy(col(time).alias("ts")).agg(F.count("*").alias("count")))
    if df.agg(F.count(col(time)).alias("n")).first()["n"] <= limit:
        recent = Window.partitionBy(F.lit(0)).orderBy("ts").rowsBetween(1 - window, 0)
        return counts.withColumn("rolling_mean", F.avg("count").over(recent))
    blocks = in_blocks(indexed(counts, ["ts"]), block_rows, window - 1)
    recent = Window.partitionBy("blk").orderBy("idx").rowsBetween(1 - window, 0)
    return (blocks.withColumn("rolling_mean", F.avg("count").over(recent))
            .filter(~F.col("is_halo")).select("ts", "count", "rolling_mean"))


def sparkline_values(df: DataFrame, order: list[str], columns: list[str] | None = None, window: int = 20,
                     cap: int | None = None) -> DataFrame:
    """(column, pos, value): the last filled values of the numeric columns, oldest first."""
    columns = (numeric_columns(df) if columns is None else columns)[:cap]
    tail = edge_values(df, columns, order, window, last=True)
    size = F.max("rn").over(Window.partitionBy("ordinal"))   # at most `window` rows per column
    return (tail.withColumn("size", size).filter(F.col("size") >= 3)
            .select("column", (F.col("size") - F.col("rn")).alias("pos"), F.col("v").cast("double").alias("value")))


def kpi_sparkline(df: DataFrame, order: list[str], columns: list[str] | None = None, window: int = 20) -> DataFrame:
    """Mean, last value and % change over each column's sparkline."""
    ends = sparkline_values(df, order, columns, window).groupBy("column").agg(
        F.count("*").alias("n_values"), F.avg("value").alias("mean"),
        F.max_by("value", "pos").alias("last"), F.min_by("value", "pos").alias("first"))
    delta = F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.abs("first")), F.lit(0.0)) * 100
    return ends.select("column", "n_values", "mean", "last", delta.alias("delta_pct"))


def trend_projection(trend: DataFrame, horizon: int = 6) -> DataFrame:
    """Straight-line continuation of a trend with a band of 1.5 residual deviations."""
    # one row per calendar period
    numbered = trend.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("period")) - 1)
    fit = numbered.agg(F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("intercept"),
                       F.regr_sxx("value", "i").alias("xx"), F.regr_sxy("value", "i").alias("xy"),
                       F.regr_syy("value", "i").alias("yy"), F.count("*").alias("n"))
    noise = F.sqrt(F.greatest(F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx"), F.lit(0.0)) / F.col("n"))
    at = F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step") - 1)
    return (fit.filter(F.col("n") >= 2)
            .select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
            .select("step", at.alias("forecast"), (at - 1.5 * noise).alias("lower"), (at + 1.5 * noise).alias("upper")))
