"""Statistics, typing and cleaning on edge frames, against pandas and NumPy."""

import numpy as np
import pandas as pd
import pytest

from tabulyze.functions.columns import require_rows
from tabulyze.operators import (
    cleaning, correlation, decision, descriptive, distribution, forecast, profiling, quantiles, segments, timeseries,
    typing as typ)
from tabulyze.operators.kernel import numeric_profile, top_values


def rows(df, key="column"):
    return {r[key]: r for r in df.collect()}


def test_moments_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.lognormal(size=500), "b": rng.normal(size=500)})
    pdf.loc[::7, "b"] = np.nan
    got = rows(descriptive.numerical_summary(spark.createDataFrame(pdf)))
    for c in pdf:
        s = pdf[c]
        assert got[c]["count"] == s.count()
        for name, want in (("mean", s.mean()), ("median", s.median()), ("std", s.std()), ("variance", s.var()),
                           ("skewness", s.skew()), ("kurtosis", s.kurt()), ("min", s.min()), ("max", s.max())):
            assert got[c][name] == pytest.approx(want, rel=1e-9)
        assert got[c]["missing_percentage"] == round(s.isna().mean() * 100, 2)


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "x double")
    p = numeric_profile(df).first()
    assert (p["skewness"], p["kurtosis"], p["std"]) == (0.0, 0.0, 0.0)
    assert typ.column_roles(df).first()["role"] == "boolean"
    assert correlation.correlation_pairs(df.selectExpr("x", "x + 1 as y")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_columns(spark, n):
    s = pd.Series([1.0, 2.0, 4.0, 9.0][:n])
    p = numeric_profile(spark.createDataFrame([(float(x),) for x in s], "x double")).first()
    assert (p["std"] is None) == (n < 2)
    assert p["skewness"] == (None if n < 3 else pytest.approx(s.skew()))
    assert p["kurtosis"] == (None if n < 4 else pytest.approx(s.kurt()))


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    p = numeric_profile(df).first()
    assert (p["n"], p["n_rows"], p["mean"], p["max"]) == (2, 4, 2.0, 3.0)
    assert profiling.quality_missing(df).first()["missing_pct"] == 50.0


def test_all_null_text_is_boolean(spark):
    df = spark.createDataFrame([(None,)] * 4, "s string")
    assert typ.column_roles(df).first()["role"] == "boolean"
    assert top_values(df).first()["top_value"] is None


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",)], "s string")
    assert top_values(df).first()["top_value"] == "a"


def test_quartiles_interpolate(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "x int")
    assert quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"] == [1.75, 2.5, 3.25]


@pytest.mark.parametrize("shape", ["normal", "heavy", "ties", "hot", "tiny", "negative"])
def test_narrowed_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(3)
    n = 4000
    x = {"normal": rng.normal(size=n), "heavy": np.exp(rng.normal(size=n) * 12),
         "ties": rng.integers(0, 7, n).astype(float), "hot": np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n)),
         "tiny": rng.random(n) * 1e-300, "negative": -rng.pareto(0.5, n)}[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x[::-1] * 2})).repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles.exact_quantiles(df, ["x", "y"], probs, pick_rows=50, accuracy=100)
    assert got["x"] == pytest.approx(list(np.quantile(x, probs)), rel=1e-12)
    assert got["y"] == pytest.approx(list(np.quantile(x * 2, probs)), rel=1e-12)


def test_pairwise_complete_correlation(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (None, 5), (3, 7), (4, 1)], "x int, y int")
    assert correlation.correlation_pairs(df).first()["r"] == pytest.approx(0.0339422117)
    assert correlation.key_drivers(df, "y").first()["regression_coef"] == pytest.approx(0.071429)


def test_correlation_of_shifted_columns(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)) + 1e7, columns=list("abcd"))
    pdf["d"] = pdf["a"] * 2 + rng.normal(size=300)
    pdf.loc[::5, "b"] = np.nan
    for r in correlation.correlation_pairs(spark.createDataFrame(pdf).repartition(4)).collect():
        both = pdf[[r["a"], r["b"]]].dropna() - 1e7
        assert r["r"] == pytest.approx(np.corrcoef(both.T)[0, 1], rel=1e-7)


def test_number_guard(spark):
    cells = ["12", " 12 ", "1d", "NaN", "inf", "abc", ""]
    df = spark.createDataFrame([(c,) for c in cells], "s string")
    got = [r[0] for r in df.select(typ.parse_number(df["s"])).collect()]
    assert got == [12.0, 12.0, None, None, float("inf"), None, None]
    assert dict(typ.promote_strict(df).dtypes)["s"] == "string"


def test_date_parsing(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024/01/02",), ("1/2/2024",), ("2024-01-02 03:04:05",), ("2024",)],
                               "s string")
    got = [r[0] for r in df.select(typ.parse_datetime(df["s"])).collect()]
    assert [g and g.strftime("%F %T") for g in got] == [
        "2024-01-02 00:00:00"] * 3 + ["2024-01-02 03:04:05", None]


def test_zero_one_is_boolean_yet_numeric(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (0,)], "flag int")
    assert typ.column_roles(df).first()["role"] == "boolean"
    assert numeric_profile(df).first()["mean"] == 0.5


def test_strict_cleaning(spark):
    df = spark.createDataFrame([("1", "a", 1.0), ("1", "a", 1.0), ("2", None, 2.0), ("3", "b", None), ("4", "b", 90.0)],
                               "s string, t string, v double")
    once = cleaning.clean_strict(df)
    assert dict(once.dtypes)["s"] == "double"       # capped columns are real
    assert sorted(map(tuple, once.collect())) == [
        (1.0, "a", 1.0), (2.0, "Unknown", 2.0), (3.0, "b", 1.5), (4.0, "b", 57.9375)]
    assert cleaning.dedupe(cleaning.dedupe(df)).count() == cleaning.dedupe(df).count() == 4
    with pytest.raises(ValueError):
        cleaning.impute_median_unknown(df, strategy="mean")


def test_histogram_matches_numpy(spark):
    x = np.random.default_rng(7).gamma(2.0, size=1000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    want, edges = np.histogram(x, bins="auto")
    got = distribution.histogram(df, "x").orderBy("bin").collect()
    assert [r["count"] for r in got] == want.tolist()
    assert [r["low"] for r in got] == pytest.approx(edges[:-1].tolist())
    flat = distribution.histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x").collect()
    assert [(r["low"], r["high"], r["count"]) for r in flat] == [(1.5, 2.5, 3)]


def test_whole_number_histogram(spark):
    x = np.random.default_rng(8).integers(0, 5, 1000)
    want, _ = np.histogram(x, bins="auto")
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert [r["count"] for r in distribution.histogram(df, "x").orderBy("bin").collect()] == want.tolist()


def test_kde_against_full_sum(spark):
    x = np.concatenate([np.random.default_rng(9).normal(size=400), [60.0]])
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    full = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (h * np.sqrt(2 * np.pi))
    got = distribution.kde_curve(spark.createDataFrame(pd.DataFrame({"x": x})), "x").orderBy("point").collect()
    assert [r["y"] for r in got] == pytest.approx((full * (x.max() - x.min()) / 35).tolist(), abs=1e-9)


def test_week_month_labels_and_gaps(spark):
    days = [(f"2024-01-{d:02d}", 1.0) for d in range(1, 15)]
    df = spark.createDataFrame(days, "d string, v double").selectExpr("cast(d as timestamp_ntz) as t", "v")
    weeks = df.groupBy(timeseries.period_end("W", df["t"]).alias("p")).count().orderBy("p").collect()
    assert [str(r["p"]) for r in weeks] == ["2024-01-07", "2024-01-14"]
    assert str(df.select(timeseries.period_end("ME", df["t"])).first()[0]) == "2024-01-31"
    gap = spark.createDataFrame([("2024-01-01", 1.0)] * 3 + [("2024-01-11", 2.0)] * 3, "d string, v double").selectExpr(
        "cast(d as timestamp_ntz) as t", "v")
    trend = timeseries.time_trend(gap, "t", "v").orderBy("period").collect()
    assert [r["value"] for r in trend] == [3.0] + [0.0] * 9 + [6.0]
    assert timeseries.period_means(gap, "t", "v", "D").count() == 2
    assert timeseries.time_trend(gap.limit(4), "t", "v").count() == 0


def test_shares_with_no_positive_total(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", -5.0)], "s string, v double")
    got = rows(segments.segment_ranking(df, "s", "v"), "segment")
    assert got["a"]["share_pct"] == pytest.approx(5.0 / 1e-9 * 100)


def test_rankings_mirror_each_other(spark):
    df = spark.createDataFrame([(f"s{i}", float(i * i)) for i in range(8)], "s string, v double")
    top = [r["segment"] for r in segments.segment_ranking(df, "s", "v").collect()]
    bottom = [r["segment"] for r in segments.segment_ranking(df, "s", "v", bottom=True).collect()]
    assert top == bottom[::-1]


def series_frame(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    return forecast.row_series(df, None, "i", "v")


def test_flat_series(spark):
    got = forecast.best(forecast.models(forecast.framed(series_frame(spark, [7] * 8)))).first()
    assert got["forecast"] == [7.0] * 6 and got["rmse"] == pytest.approx(0.0)
    assert got["resid_std"] == 1.0 and got["confidence"] == pytest.approx(100 * (1 - 1 / 7))


def test_models_match_formulas(spark):
    y = np.random.default_rng(11).normal(size=300).cumsum() + 50
    fits = forecast.models(forecast.framed(series_frame(spark, y))).first()
    slope, intercept = np.polyfit(np.arange(300), y, 1)
    smooth = pd.Series(y).ewm(alpha=0.3, adjust=False).mean().to_numpy()
    moving = pd.Series(y).rolling(5, min_periods=1).mean().to_numpy()
    rolling = pd.Series(y).rolling(5, min_periods=1).std().fillna(0)
    assert fits["slope"] == pytest.approx(slope) and fits["intercept"] == pytest.approx(intercept)
    assert fits["exp_last"] == pytest.approx(smooth[-1]) and fits["ma_last"] == pytest.approx(moving[-1])
    for name, fit in (("rmse_linear", np.polyval([slope, intercept], np.arange(300))),
                      ("rmse_exponential", smooth), ("rmse_moving", moving)):
        assert fits[name] == pytest.approx(np.sqrt(np.mean((y - fit) ** 2)))
    assert fits["std_exponential"] == pytest.approx(np.std(y - smooth))
    assert fits["roll_std"] == pytest.approx(rolling.mean())


def test_only_growth_and_demand_are_elastic(spark):
    frame = forecast.framed(series_frame(spark, [1, 3, 2, 5, 4, 6, 8, 7]))
    fits = forecast.models(frame)
    risk = decision.risk_projection(forecast.best(fits), decision.two_sigma_shares(frame, fits), 0.5)
    got = {r["lever"]: r["elasticity"] for r in decision.sensitivity(risk).collect()}
    assert got == pytest.approx({"Growth": 1.0, "Demand Shock": 1.0, "Volatility": 0.0, "Concentration": 0.0})


def test_empty_table_is_rejected(spark):
    with pytest.raises(ValueError):
        require_rows(spark.createDataFrame([], "x int"))


def test_tables_of_hundreds_of_columns(spark):
    n = 150
    df = spark.range(40).selectExpr(*[f"cast(id * {i + 1} % 37 as double) as c{i}" for i in range(n)])
    pdf = df.toPandas()
    got = rows(numeric_profile(df))
    assert len(got) == n and all(got[f"c{i}"]["ordinal"] == i for i in range(n))
    assert got["c149"]["mean"] == pytest.approx(pdf["c149"].mean())
    medians = quantiles.exact_quantiles(df, df.columns, [0.5])
    assert [medians[c][0] for c in df.columns] == pytest.approx(pdf.median().tolist())
    roles = typ.column_roles(df).collect()
    assert sorted(r["ordinal"] for r in roles) == list(range(n))
