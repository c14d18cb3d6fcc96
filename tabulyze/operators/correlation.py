"""Pairwise correlation, drivers and least-squares lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabulyze.functions.columns import clip, col, number, number_sql, numeric_columns, pick, quoted, rounded
from tabulyze.operators.kernel import numeric_profile


def pair_moments(df: DataFrame, columns: list[str], means: dict[str, float | None] | None = None,
                 first_only: bool = False) -> DataFrame:
    """Sums over the rows where both columns are filled, one row per pair a < b.

    Every pair needs its own row mask, which as SQL aggregates means thousands
    of buffer slots for a wide table. Each Arrow batch gives the same sums as
    four matrix products, and tasks emit one small row per pair. Values are
    shifted by the column means first (``means`` if known), so the sums do not cancel.
    ``first_only`` keeps the pairs of the first column. ``endless`` marks pairs that meet an
    infinite value, which have no moments.
    """
    centre = ([means[c] for c in columns] if means is not None else
              df.selectExpr(*[f"avg({number_sql(df, c)}) as m{i}" for i, c in enumerate(columns)]).first())
    shift = np.array([0.0 if m is None or not np.isfinite(m) else m for m in centre])
    if first_only:
        a, b = np.zeros(len(columns) - 1, int), np.arange(1, len(columns))
    else:
        a, b = np.triu_indices(len(columns), k=1)
    left = slice(0, 1) if first_only else slice(None)
    names = ["n", "sa", "sb", "saa", "sbb", "sab", "endless"]

    def products(batches):
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            filled = (~np.isnan(x)).astype(float)
            endless = np.isinf(x).astype(float)
            x = np.where(np.isfinite(x), x, 0.0)
            f, v = filled[:, left].T, x[:, left].T
            part = np.array([(f @ filled)[a, b], (v @ filled)[a, b], (f @ x)[a, b], ((v * v) @ filled)[a, b],
                             (f @ (x * x))[a, b], (v @ x)[a, b], (endless[:, left].T @ filled + f @ endless)[a, b]])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.astype("int32")), pa.array(b.astype("int32")), *[pa.array(t) for t in total]],
                names=["a_ordinal", "b_ordinal", *names])

    schema = "a_ordinal int, b_ordinal int, " + ", ".join(f"{n} double" for n in names)
    cells = df.selectExpr(*[f"{number_sql(df, c)} as c{i}" for i, c in enumerate(columns)])
    return (cells.mapInArrow(products, schema).groupBy("a_ordinal", "b_ordinal")
            .agg(*[F.sum(n).alias(n) for n in names])
            .select(pick(columns, "a_ordinal").alias("a"), pick(columns, "b_ordinal").alias("b"),
                    "a_ordinal", "b_ordinal", F.col("n").cast("long").alias("n"),
                    (F.col("saa") - F.try_divide(F.col("sa") * F.col("sa"), "n")).alias("xx"),
                    (F.col("sbb") - F.try_divide(F.col("sb") * F.col("sb"), "n")).alias("yy"),
                    (F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), "n")).alias("xy"),
                    F.col("saa").alias("raw_xx"), F.col("sbb").alias("raw_yy"), (F.col("endless") > 0).alias("endless")))


def _spread(part: str, raw: str):
    """A centred sum of squares; none when only rounding noise is left, or with an infinite value."""
    return F.when((F.col(part) > F.col(raw) * 1e-14) & ~F.col("endless"), F.col(part))


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, cap: int | None = None,
                      means: dict[str, float | None] | None = None) -> DataFrame:
    """(a, b, r) over pairwise-complete rows; pairs with a constant side have no r.

    ``cap`` keeps that many columns, the ones with the largest variance.
    """
    columns = numeric_columns(df) if columns is None else columns
    if cap is not None and len(columns) > cap:
        kept = (numeric_profile(df, columns, shape=False)
                .orderBy(F.col("variance").desc_nulls_last(), "ordinal").limit(cap).select("column").collect())
        columns = [r["column"] for r in kept]
    if len(columns) < 2:
        return df.sparkSession.createDataFrame(
            [], "a string, b string, a_ordinal int, b_ordinal int, n long, r double")
    return with_r(pair_moments(df, columns, means))


def with_r(moments: DataFrame) -> DataFrame:
    """(a, b, a_ordinal, b_ordinal, n, r) of ``pair_moments``; pairs with a constant side are left out."""
    r = F.try_divide(F.col("xy"), F.sqrt(_spread("xx", "raw_xx")) * F.sqrt(_spread("yy", "raw_yy")))
    return (moments.select("a", "b", "a_ordinal", "b_ordinal", "n",
                           F.when(F.col("n") > 1, clip(r, F.lit(-1.0), F.lit(1.0))).alias("r"))
            .filter(F.col("r").isNotNull()))


def strongest(pairs: DataFrame, top: int | None) -> DataFrame:
    """Pairs by the size of r, the earlier columns first among equals."""
    ranked = pairs.orderBy(F.abs("r").desc(), "a_ordinal", "b_ordinal")
    return ranked.limit(top) if top else ranked


def corr_matrix(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Both triangles and the diagonal in long form."""
    return correlation_pairs(df, cap=cap).select(F.inline(F.array(
        F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.col("r").alias("r")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r").alias("r")),
        F.struct(F.col("a").alias("a"), F.col("a").alias("b"), F.lit(1.0).alias("r")),
        F.struct(F.col("b").alias("a"), F.col("b").alias("b"), F.lit(1.0).alias("r"))))
    ).groupBy("a", "b").agg(F.max("r").alias("r"))


def corr_strongest(df: DataFrame, top: int = 10, high: float = 0.75, cap: int | None = None,
                   columns: list[str] | None = None) -> DataFrame:
    """The strongest pairs, and every pair at or above ``high``, with both flags."""
    pairs = correlation_pairs(df, columns, cap=cap).select(
        "a", "b", "a_ordinal", "b_ordinal", F.col("r"), (F.abs("r") >= high).alias("is_high"))
    best = strongest(pairs, top).select("a", "b", F.lit(True).alias("is_top"))
    return (pairs.join(F.broadcast(best), ["a", "b"], "left")   # at most `top` rows
            .filter(F.col("is_top") | F.col("is_high"))
            .select("a", "b", rounded("r", 4).alias("r"), F.coalesce("is_top", F.lit(False)).alias("is_top"),
                    "is_high"))


def corr_top(df: DataFrame, top: int = 5, cap: int | None = None) -> DataFrame:
    """The strongest pairs by the size of r rounded to four places."""
    pairs = correlation_pairs(df, cap=cap).withColumn("r", rounded("r", 4))
    return strongest(pairs, top).select(F.col("a").alias("col_a"), F.col("b").alias("col_b"),
                                         F.col("r").alias("correlation"))


def corr_labelled(df: DataFrame, top: int = 15) -> DataFrame:
    """The strongest pairs with a strength label."""
    pairs = correlation_pairs(df).withColumn("r", rounded("r", 4))
    size = F.abs("r")
    return strongest(pairs, top).select(
        F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), F.col("r").alias("correlation"),
        F.when(size >= 0.8, "Very Strong").when(size >= 0.6, "Strong").when(size >= 0.4, "Moderate")
        .when(size >= 0.2, "Weak").otherwise("Negligible").alias("strength"))


def corr_heatmap(df: DataFrame, pairs: int = 15, features: int = 12) -> DataFrame:
    """Square matrix over the features named by the strongest pairs, 0 where a pair is not listed."""
    listed = corr_labelled(df, pairs).collect()   # at most `pairs` rows
    names = list(dict.fromkeys(n for r in listed[:20] for n in (r["feature_a"], r["feature_b"])))[:features]
    r = {(x["feature_a"], x["feature_b"]): x["correlation"] for x in listed}
    cell = lambda a, b: 1.0 if a == b else r.get((a, b), r.get((b, a), 0.0))
    schema = ", ".join(["feature string", *[f"{quoted(n)} double" for n in sorted(names)]])
    return df.sparkSession.createDataFrame([(a, *[cell(a, b) for b in sorted(names)]) for a in names], schema)


def corr_top_abs(df: DataFrame, top: int = 5) -> DataFrame:
    return strongest(correlation_pairs(df), top).select(
        F.col("a").alias("col_a"), F.col("b").alias("col_b"), rounded(F.abs("r"), 4).alias("abs_r"))


def multicollinearity(df: DataFrame, above: float = 0.92) -> DataFrame:
    return correlation_pairs(df).filter(F.abs("r") > above).select(
        "a", "b", rounded(F.abs("r"), 4).alias("abs_r"))


def key_drivers(df: DataFrame, target: str) -> DataFrame:
    """r and least-squares slope of the target on every other numeric column, strongest first."""
    columns = [target] + [c for c in numeric_columns(df) if c != target]
    # the target is ordinal 0, so it is side `a` of each of its pairs
    return drivers_of(pair_moments(df, columns, first_only=True))


def drivers_of(moments: DataFrame) -> DataFrame:
    """The drivers from ``pair_moments`` whose side ``a`` is the target."""
    pairs = moments.filter(F.col("n") >= 2)
    r = F.try_divide(F.col("xy"), F.sqrt(_spread("xx", "raw_xx")) * F.sqrt(_spread("yy", "raw_yy")))
    slope = F.coalesce(F.try_divide(F.col("xy"), _spread("yy", "raw_yy")), F.lit(0.0))
    out = pairs.select(F.col("b").alias("column"), F.col("b_ordinal"), r.alias("r"), slope.alias("slope"))
    return (out.select("column", "b_ordinal", rounded("r", 4).alias("correlation"),
                       rounded(F.abs("r"), 4).alias("abs_correlation"),
                       rounded("slope", 6).alias("regression_coef"),
                       F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction"))
            .orderBy(F.col("abs_correlation").desc_nulls_last(), "b_ordinal").drop("b_ordinal"))


def driver_summary(df: DataFrame, target: str, top: int = 6, bars: int = 8) -> DataFrame:
    """The first drivers with the width of their bar relative to the strongest."""
    first = key_drivers(df, target).limit(bars)
    # at most `bars` rows
    everything = Window.partitionBy(F.lit(0))
    rank = Window.partitionBy(F.lit(0)).orderBy(F.col("abs_correlation").desc_nulls_last(), "column")
    return first.select(
        "column", "correlation", "direction",
        F.coalesce((F.try_divide(F.col("abs_correlation"), F.max("abs_correlation").over(everything)) * 100)
                   .cast("int"), F.lit(0)).alias("bar_width"),
        (F.row_number().over(rank) <= top).alias("in_summary"))


def ols_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Fitted line of y on x at evenly spaced points over the range of x."""
    xv, yv = number(df, x), number(df, y)
    both = df.select(xv.alias("x"), yv.alias("y")).dropna()
    fit = both.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                   F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    at = F.col("low") + F.col("step") * (F.col("high") - F.col("low")) / (points - 1)
    return fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step")).select(
        "step", at.alias("x"), (F.col("intercept") + F.col("slope") * at).alias("fit"), "slope", "intercept", "n")


def scatter_points(df: DataFrame, x: str, y: str, colour: str | None = None, key: str | None = None,
                   max_colours: int = 20) -> DataFrame:
    """Every point with both coordinates and its category; ``too_many_colours`` says that the
    category has more than ``max_colours`` values."""
    out = df.select(*([col(key).alias("key")] if key else []), number(df, x).alias("x"), number(df, y).alias("y"),
                    *([col(colour).cast("string").alias("colour")] if colour else []))
    out = out.dropna(subset=["x", "y"])
    if colour:
        many = df.select(col(colour)).dropna().distinct().limit(max_colours + 1).count() > max_colours
        out = out.withColumn("too_many_colours", F.lit(many))
    return out


def scatter_matrix(df: DataFrame, key: str, columns: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """The numeric columns, or the first ``cap``, side by side for a matrix of scatter plots."""
    columns = (numeric_columns(df) if columns is None else columns)[:cap]
    return df.select(col(key).alias("key"), *[number(df, c).alias(c) for c in columns])
