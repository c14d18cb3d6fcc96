"""The paths taken only by large tables, forced on small ones and compared with the plain answer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tabulyze.functions import lookup
from tabulyze.functions.ordering import in_blocks, indexed
from tabulyze.operators import anomalies, decision, features, forecast, kernel, timeseries
from tabulyze.sources.tables import Tables


def plan(df):
    return df._jdf.queryExecution().toString()


def test_index_is_the_sorted_position(spark):
    df = spark.range(5000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = indexed(df, ["k"]).orderBy("k").select("idx").collect()
    assert [r["idx"] for r in got] == list(range(5000))


def test_blocks_cover_every_row_once(spark):
    blocks = in_blocks(spark.range(1000).withColumn("idx", F.col("id")), 100, 10)
    assert blocks.filter("not is_halo").count() == 1000
    assert blocks.filter("is_halo").count() == 100
    with pytest.raises(ValueError):
        in_blocks(blocks, 5, 5)


def test_rolling_counts_by_block(spark):
    ts = spark.range(3000).selectExpr(
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(id % 700 * (id % 3 + 1) as decimal(18,6))) as ts")
    plain = timeseries.event_counts_rolling(ts, "ts").orderBy("ts").collect()
    blocked = timeseries.event_counts_rolling(ts, "ts", window_rows=0, block_rows=50).orderBy("ts").collect()
    assert plain == blocked


@pytest.mark.parametrize("hot", [0.34, 0.0])
def test_forecast_by_block(spark, hot):
    rng = np.random.default_rng(2)
    n = 6000
    key = np.where(rng.random(n) < hot, "hot", [f"s{i % 9}" for i in range(n)])
    df = spark.createDataFrame(pd.DataFrame({"k": key, "i": np.arange(n), "v": rng.normal(size=n).cumsum() + 200}))
    series = forecast.row_series(df, "k", "i", "v")
    frames = [forecast.framed(series), forecast.framed(series, series_rows=10, block_rows=400)]
    fits = [sorted(forecast.models(f).collect(), key=lambda r: r["series"]) for f in frames]
    for a, b in zip(*fits):
        for name in a.asDict():
            assert a[name] == b[name] if name == "series" else a[name] == pytest.approx(b[name], rel=1e-7, abs=1e-9)
    shares = [sorted(map(tuple, decision.two_sigma_shares(f, forecast.models(f)).collect())) for f in frames]
    assert shares[0] == shares[1]
    fitted = [sorted(map(tuple, forecast.fitted(f, forecast.models(f)).drop("value").collect())) for f in frames]
    for a, b in zip(*fitted):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)


def test_lookup_beyond_broadcast(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null "
                                      "else concat('v', id % 600) end as s")
    want = sorted(map(tuple, features.frequency_encode(df).collect()), key=lambda r: r[0])
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(lookup, "HOT_ROWS", 200)
    out = features.frequency_encode(df)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == want
    assert len(want) == 4000
    encoded = pd.Series([r[1] for r in want])
    shares = encoded.value_counts(normalize=True)
    for r in want[:50]:
        assert (r[2] is None) == (r[1] is None) and (r[1] is None or r[2] == pytest.approx(shares[r[1]]))


def test_sparse_columns_get_their_own_top_n(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 1000 = 999 then id end as rare", "cast(null as int) as never")
    got = kernel.edge_values(df, ["id", "rare", "never"], ["id"], 2, probe_rows=10)
    assert sorted((r["column"], r["rn"], r["v"]) for r in got.collect()) == [
        ("id", 1, "0"), ("id", 2, "1"), ("rare", 1, "999"), ("rare", 2, "1999")]


def test_long_text_cells_compare_by_digest(spark):
    long = "x" * 200
    df = spark.createDataFrame([(long,), (long,), (long + "y",), ("x",), (None,)], "s string")
    assert kernel.row_counts(df).first()["distinct_rows"] == 4
    assert kernel.distinct_profile(df).first()["n_distinct"] == 3


def test_fences_reach_the_scan(spark, sf_dir):
    events = Tables(spark, sf_dir).events.select("event_id", "value")
    text = plan(anomalies.iqr_outlier_rows(events, "value"))
    assert "PushedFilters: [Or(" in text


def test_profiles_read_only_their_columns(spark, sf_dir):
    text = plan(kernel.numeric_profile(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_tax"]))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text
    assert text.count("FileScan") <= 4   # one scan, shown once per plan stage


@pytest.mark.parametrize("name", [
    "executive_kpis", "segment_ranking_top", "segment_gap", "kde_curve", "scenario_grid", "cap_outliers", "time_trend",
    "quality_score_app", "histogram_fixed", "key_drivers", "risk_watchlist"])
def test_no_cross_joins(spark, sf_dir, name):
    from tabulyze.plans.catalog import QUERIES

    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_share_total_is_a_scalar_subquery(spark, sf_dir):
    from tabulyze.operators.segments import segment_ranking

    text = plan(segment_ranking(Tables(spark, sf_dir).events, "event_type", "value"))
    assert "Window" not in text and "TakeOrderedAndProject" in text


def test_samples_are_cut_before_the_shuffle(spark, sf_dir):
    text = plan(anomalies.anomaly_summary(Tables(spark, sf_dir).events, "event_id"))
    assert "WindowGroupLimit" in text
