"""Wide tables, infinite and empty columns, far values and long series: nothing is left out."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulyze.operators import (
    anomalies, cleaning, correlation, descriptive, distribution, forecast, kernel, profiling, quantiles, report, rules, timeseries)


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(8)
    data = {f"n{i:02d}": rng.normal(size=40) + i for i in range(60)}
    data["n59"] = data["n00"] * 3
    data |= {f"t{i:02d}": [f"v{k % (i + 2)}" for k in range(40)] for i in range(20)}
    data["t19"] = ["same"] * 38 + ["x", "y"]
    return spark.createDataFrame(pd.DataFrame(data).assign(row=range(40))).cache()


def test_no_column_is_left_out(wide):
    numbers = [f"n{i:02d}" for i in range(60)]
    assert {r.column for r in distribution.box_stats(wide).collect()} >= set(numbers)
    assert {r.column for r in profiling.mini_profile(wide).collect()} >= set(numbers)
    assert {r.column for r in timeseries.sparkline_values(wide, ["row"]).collect()} >= set(numbers)
    found = profiling.dataset_profile(wide).collect()
    assert {r.column for r in found if r.section == "cardinality"} == {f"t{i:02d}" for i in range(20)}
    assert {r.column for r in found if r.section == "descriptive"} >= set(numbers)
    assert (correlation.corr_top(wide, 1).first()["col_a"], correlation.corr_top(wide, 1).first()["col_b"]) == ("n00", "n59")
    assert correlation.corr_matrix(wide).select("a").distinct().count() == 61
    assert "n00 × n59" in {r.column for r in rules.hidden_patterns(wide).collect()}
    assert "t19" in {r.column for r in rules.risk_watchlist(wide).collect()}
    assert len(descriptive.column_means_ranked(wide, top=100).collect()) == 61
    listed = report.report_tables(wide, wide.sparkSession.createDataFrame([], "severity string, category string, description string"))
    assert listed.where("section = 'inventory'").count() == 81


@pytest.mark.parametrize("shape", ["infinite", "both", "constant", "tails", "denormal", "mass"])
def test_quantiles_of_odd_columns(spark, shape):
    rng = np.random.default_rng(1)
    x = {"infinite": np.append(rng.normal(size=6000), [np.inf]), "both": np.append(rng.normal(size=6000), [np.inf, -np.inf, np.inf]),
         "constant": np.full(6000, 7.0), "tails": np.exp(rng.normal(size=6000) ** 2 * 3), "denormal": rng.random(6000) * 1e-310,
         "mass": np.where(rng.random(6000) < 0.6, 0.0, rng.normal(size=6000))}[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(6)
    probs = [0.0, 0.25, 0.99]
    want = list(pd.Series(x).quantile(probs))
    for pick, accuracy in ((20_000, 10_000), (100, 200)):
        got = quantiles.exact_quantiles(df, ["x"], probs, pick_rows=pick, accuracy=accuracy)["x"]
        assert got[1:] == pytest.approx(want[1:], rel=1e-12)
        assert got[0] == min(x)


def test_infinite_pairs_have_no_r(spark):
    df = spark.createDataFrame([(1.0, math.inf, 5.0), (2.0, 3.0, 1.0), (3.0, 4.0, None), (4.0, 9.0, 2.0)], "x double, y double, z double")
    got = {(r.a, r.b): r.r for r in correlation.correlation_pairs(df).collect()}
    assert set(got) == {("x", "z")}
    assert correlation.multicollinearity(df).where("b = 'y' or a = 'y'").count() == 0


def test_nan_and_null_rows_are_equal(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,), (None,)], "x double")
    assert cleaning.dedupe(df).count() == kernel.row_counts(df).first()["distinct_rows"] == 2


def test_empty_columns_give_empty_findings(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k long, x double")
    assert anomalies.anomaly_bands(df, "x", "k").count() == 0
    assert anomalies.two_sigma_share(df, "x").first()["share"] is None
    for method in ("zscore", "iqr"):
        assert anomalies.anomaly_summary(df.select("x", F.col("k").cast("string").alias("k")), "k", method).count() == 0


def test_density_is_positive_everywhere(spark):
    x = [*np.random.default_rng(2).normal(size=400), 30.0]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    h = np.std(x, ddof=1) * len(x) ** -0.2
    got = distribution.kde_curve(df, "x").orderBy("point").collect()
    want = [np.exp(-0.5 * ((g - np.array(x)) / h) ** 2).sum() * (max(x) - min(x)) / 35 / (h * math.sqrt(2 * math.pi))
            for g in np.linspace(min(x), max(x), 200)]
    assert [r.y for r in got] == pytest.approx(want, rel=1e-9)
    assert distribution.kde_curve(df.limit(10), "x").count() == 0


@pytest.mark.parametrize("blocks", [{}, {"series_rows": 10, "block_rows": 50}])
def test_smoothing_remembers_everything(spark, blocks):
    values = [1e30, *[1.0] * 399]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, i long, v double")
    frame = forecast.framed(forecast.row_series(df, "k", "i", "v"), **blocks)
    want = pd.Series(values).ewm(alpha=0.3, adjust=False).mean()
    fits = forecast.models(frame)
    got = [r.exponential for r in forecast.fitted(frame, fits).orderBy("t").collect()]
    assert got == pytest.approx(list(want), rel=1e-9)
    assert fits.first()["exp_last"] == pytest.approx(want.iloc[-1], rel=1e-9)


def test_top_value_of_long_texts(spark):
    a, b = "b" + "x" * 100, "a" + "y" * 100
    df = spark.createDataFrame([(a, "p"), (a, "q"), (b, "q"), (b, None), ("short", None), (None, None)], "s string, t string")
    got = {r.column: r for r in kernel.top_values(df).collect()}
    assert (got["s"].top_value, got["s"].top_n, got["s"].n_distinct, got["s"].n) == (b, 2, 3, 5)
    assert (got["t"].top_value, got["t"].top_n) == ("q", 2)
