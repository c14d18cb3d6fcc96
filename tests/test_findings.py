"""Merged findings, gates, stored distinct states and context records of any depth."""

import json

import pytest
from pyspark.sql import Row, functions as F

from tabulyze.operators import findings, forecast, gates, profiling, report, rules, sketches
from tabulyze.operators.decision import decision_signals


# ---------------------------------------------------------------- merging

def test_the_first_stage_wins_and_gaps_are_filled(spark):
    a = spark.createDataFrame([("x", 1.0, None), (None, 2.0, "n")], "k string, v double, note string")
    b = spark.createDataFrame([("x", 9.0, "late", 7), ("y", 3.0, None, 8)], "k string, v double, note string, extra int")
    got = {r["k"]: r for r in findings.merged({"a": a, "b": b}, ["k"]).collect()}
    assert got["x"] == Row(k="x", v=1.0, note="late", extra=7, source="a", also=["a", "b"])
    assert got["y"] == Row(k="y", v=3.0, note=None, extra=8, source="b", also=["b"])
    assert got[None] == Row(k=None, v=2.0, note="n", extra=None, source="a", also=["a"])
    alone = {r["k"]: r for r in findings.merged({"a": a, "b": b}, ["k"], overlay=False).collect()}
    assert (alone["x"]["note"], alone["x"]["extra"]) == (None, None)
    turned = {r["k"]: r for r in findings.merged({"b": b, "a": a}, ["k"]).collect()}
    assert turned["x"]["v"] == 9.0 and turned["x"]["source"] == "b"


def test_repeated_keys_and_empty_stages(spark):
    rows = spark.createDataFrame([("x", 2.0), ("x", 1.0)] * 50, "k string, v double")
    assert findings.merged({"a": rows}, ["k"]).collect() == [Row(k="x", v=1.0, source="a", also=["a"])]
    assert findings.merged({"none": rows.where("false"), "a": rows}, ["k"]).first()["source"] == "a"
    assert findings.merged({"none": rows.where("false")}, ["k"]).count() == 0
    with pytest.raises(ValueError):
        findings.merged({}, ["k"])
    assert findings.first_filled(None, rows.where("false"), rows).count() == 100


def test_payload_takes_over_every_kind_of_earlier_finding(spark):
    df = spark.range(60).selectExpr("id", "cast(id * 2 as double) as a", "cast(id * id as double) as b", "concat('s', id % 3) as s")
    prior = {"kpis": spark.createDataFrame([("a", -1.0)], "column string, mean double"),
             "correlations": spark.createDataFrame([("p", "q", 0.5, "Moderate")], "feature_a string, feature_b string, correlation double, strength string"),
             "risks": spark.createDataFrame([("late delivery", "High")], "description string, severity string"),
             "segments": spark.createDataFrame([("s1", 4.0)], "segment string, value double"),
             "drivers": spark.createDataFrame([("b", 0.9)], "column string, correlation double")}
    got = report.report_payload(df, ["id"], prior=prior).first()
    kpis = {r["column"]: r for r in got["kpis"]}
    assert kpis["a"]["mean"] == -1.0 and kpis["a"]["source"] == "earlier" and kpis["a"]["median"] == 59.0
    assert kpis["b"]["source"] == "report"
    assert [r["feature_a"] for r in got["correlations"]] == ["p"]
    assert "late delivery" in [r["description"] for r in got["risk_factors"]]
    assert got["segments"][0]["value"] == 4.0 and got["drivers"][0]["column"] == "b"
    assert {r["source"] for r in report.report_payload(df, ["id"]).first()["kpis"]} == {"report"}


# ---------------------------------------------------------------- evidence

def test_findings_say_what_they_rest_on(spark):
    df = spark.range(200).selectExpr("id", "if(id = 7, 1e6D, id % 5) as v", "if(id % 9 = 0, null, 'same') as s")
    risks = {(r["risk"], r["column"]): r for r in rules.risk_watchlist(df).collect()}
    far = risks["Anomaly Pressure", "v"]
    assert far["evidence"]["n_anomalies"] == 1 and far["evidence"]["max_z"] > 10
    assert far["message"] == f"v: 1 values beyond three deviations (0.50%), the farthest at {far['evidence']['max_z']:.1f}"
    assert risks["Concentration Risk", "s"]["evidence"] == {"top_share": 1.0, "top_n": 177.0, "filled": 177.0}
    assert risks["Missing Data", "s"]["message"] == "s: 23 cells missing (11.5%)"
    patterns = rules.hidden_patterns(df)
    assert all(r["message"] and r["evidence"]["n"] == 200 for r in patterns.collect())
    assert {r["measure"] for r in rules.evidence_rows(patterns, "type").collect()} >= {"kurtosis", "skewness", "cv", "n"}
    assert set(risks) == {(r["risk"], r["column"]) for r in rules.risk_watchlist(df).select("risk", "column").collect()}


def test_every_signal_has_a_rationale(spark):
    rows = [("grow", [1.0, 1.2], 0.1, 0.1, 0.0), ("lump", [1.0, 1.2], 0.1, 0.9, 0.0), ("slow", [1.0, 1.02], 0.3, 0.1, 0.0),
            ("fall", [1.0, 0.5], 0.1, 0.1, 0.2), ("flat", [1.0, 1.0], 0.1, 0.1, 0.0)]
    risk = spark.createDataFrame(rows, "series string, forecast array<double>, volatility double, concentration_risk double, anomaly_pressure double")
    got = decision_signals(risk).collect()
    assert {r["signal"] for r in got} == {"Expansion Opportunity", "Diversification Required", "Cautious Optimism", "Contraction Alert",
                                          "Hedge Exposure", "Operational Risk Flag", "Stable State"}
    assert all(r["rationale"].startswith(r["series"] + ": ") and set(r["evidence"]) == {
        "growth_pct", "volatility", "concentration_risk", "pressure_pct"} for r in got)


# ---------------------------------------------------------------- gates

def test_gates_of_full_short_and_empty_tables(spark):
    df = spark.range(12).selectExpr("id", "if(id < 3, id, null) as few", "'t' as s")
    got = {(r["operator"], r["column"]): r for r in gates.dataset_gates(df).collect()}
    assert got["anomalies", "id"]["passes"] and not got["anomalies", "few"]["passes"]
    assert got["iqr_outliers", "few"]["found"] == 3 and got["iqr_outliers", "few"]["needed"] == 4
    assert got["forecast", None]["passes"] and not got["regression_model", None]["passes"]
    assert got["time_series_model", None]["lacking"] == "datetime columns"
    assert not any(r["passes"] for r in gates.dataset_gates(df.where("false")).collect())
    texts = gates.dataset_gates(df.select("s")).collect()
    assert {r["operator"] for r in texts} == set(gates.TABLE_GATES)
    assert next(r for r in texts if r["operator"] == "forecast")["lacking"] == "numeric columns"


def test_a_short_series_is_refused_by_a_row(spark):
    df = spark.createDataFrame([("long", k, float(k)) for k in range(9)] + [("short", k, 1.0) for k in range(4)], "k string, i int, v double")
    frame = forecast.framed(forecast.row_series(df, "k", "i", "v"))
    out = gates.with_refusals(forecast.summary(forecast.best(forecast.models(frame)), "v"), gates.series_gates(frame)).collect()
    got = {r["series"]: r for r in out}
    assert got["long"]["available"] and got["long"]["refusal"] is None and got["long"]["model_used"]
    assert not got["short"]["available"] and got["short"]["refusal"] == "needs 6 rows, has 4" and got["short"]["model_used"] is None


# ---------------------------------------------------------------- distinct states

def test_states_unite_over_days_within_the_error_bound(spark):
    df = spark.range(60_000).selectExpr("id % 30 as day", "id as key", "id % 700 as few", "if(id % 2 = 0, -0.0D, 0.0D) as zero",
                                        "cast(null as string) as nothing", "if(id % 3 = 0, double('NaN'), id % 11) as gaps")
    states = sketches.distinct_states(df, "day")
    assert states.count() == 30 * 5
    whole = {r["column"]: r for r in sketches.estimated(sketches.united(states)).collect()}
    exact = {r["column"]: r["cardinality"] for r in profiling.cardinality(df.drop("day"), count_null=False).collect()}
    for c, r in whole.items():
        assert abs(r["n_distinct"] - exact[c]) <= max(0, exact[c] * sketches.relative_error())
        assert r["n_rows"] == 60_000
    assert whole["nothing"]["n_distinct"] == 0 and whole["zero"]["n_distinct"] == 1 and whole["gaps"]["n"] == 40_000
    halves = [sketches.united(states.where(f"day % 2 = {k}")) for k in (0, 1)]
    again = {r["column"]: r["n_distinct"] for r in sketches.estimated(sketches.united(halves[0].unionAll(halves[1]))).collect()}
    assert again == {c: r["n_distinct"] for c, r in whole.items()}
    assert sketches.distinct_states(df.where("false")).count() == 0


# ---------------------------------------------------------------- contexts

NESTED = """
    select named_struct('forecast_values', array(1, 2), 'model', 'm', 'inner', named_struct('lower', array(1.0D), 'note', 'n',
        'deep', array(named_struct('upper', 1, 'step', 2), null))) as forecast_intelligence,
      transform(sequence(1, 20), x -> named_struct('a', x, 'explanation', 'long')) as correlations,
      map('north', sequence(1, 9), 'south', array(1)) as segment_performance,
      named_struct('count', 2, 'details', map_from_entries(transform(sequence(1, 8), x -> struct(concat('c', x), x)))) as anomaly_analysis,
      named_struct('recent_12_periods', map_from_entries(transform(sequence(1, 12), x -> struct(concat('p', lpad(x, 2, '0')), x))), 'slope', 1.5D) as trend_analysis,
      named_struct('descriptive_stats', map('v', map('mean', 1.0D, 'median', 2.0D, 'max', 3.0D)), 'rows', 9) as dataset_summary,
      cast(null as struct<fitted: int, kept: int>) as nothing, named_struct('upside', 1) as emptied, sequence(1, 9) as recent_periods, 5 as fitted"""


def test_trimming_reaches_any_depth(spark):
    out = report.trim_context(spark.sql(NESTED))
    got = json.loads(report.to_record(out).first()["record"])
    assert "fitted" not in out.columns and got["recent_periods"] == [4, 5, 6, 7, 8, 9]
    assert got["forecast_intelligence"] == {"model": "m", "inner": {"note": "n", "deep": [{"step": 2}, None]}}
    assert got["correlations"] == [{"a": k} for k in range(1, 11)]
    assert got["segment_performance"] == {"north": [1, 2, 3, 4, 5], "south": [1]}
    assert got["anomaly_analysis"] == {"count": 2, "details": {f"c{k}": k for k in range(1, 6)}}
    assert got["trend_analysis"] == {"recent_6_periods": {f"p{k:02d}": k for k in range(7, 13)}, "slope": 1.5}
    assert got["dataset_summary"] == {"descriptive_stats": {"v": {"mean": 1.0, "max": 3.0}}, "rows": 9}
    assert "nothing" not in got and "emptied" not in got
    own = report.Trimming(dropped=("a.b",), first={"a.*": 1}, last={}, only={}, renamed={"a.c": "d"})
    small = spark.sql("select named_struct('b', 1, 'c', array(1, 2), 'forecast', 3) as a")
    assert json.loads(report.to_record(report.trim_context(small, own)).first()["record"]) == {"a": {"d": [1], "forecast": 3}}


def test_paths_match_whole_names():
    fits = lambda p, x: report._fits(tuple(p.split(".")), tuple(x.split(".")))
    assert fits("**.lower", "lower") and fits("**.lower", "a.b.lower") and not fits("**.lower", "a.lower.b")
    assert fits("a.*", "a.b") and not fits("a.*", "a") and not fits("a.*", "a.b.c")


def test_contexts_are_assembled_from_their_parts(spark):
    part = spark.sql("select 1 as x, 'why' as explanation")
    nested = spark.sql("select named_struct('y', 2, 'explanation', 'why', 'm', map('k', 1)) as structured, 'raw' as other")
    pairs = spark.createDataFrame([(2, "b"), (1, "a")], "size int, name string")
    out = report.assemble_context(kpis=part, insight_drivers=nested, scenario_insight=part, correlations=pairs, risk_factors=None,
                                  forecast_summary=part.where("false"))
    got = json.loads(report.to_record(out).first()["record"])
    assert got == {"kpis": {"x": 1, "explanation": "why"}, "correlations": [{"size": 1, "name": "a"}, {"size": 2, "name": "b"}],
                   "scenario_insight": {"x": 1}, "key_driver_analysis": {"y": 2, "m": {"k": 1}}}
    with pytest.raises(ValueError):
        report.assemble_context(unheard=part)
    with pytest.raises(ValueError):
        report.assemble_context(kpis=None)
    assert len(report.CONTEXT_PARTS) == 19
    merged = report.merge_context(a=part, b=nested.select("structured.m"), c=None)
    assert merged.columns == ["a", "b"] and merged.first()["b"]["m"] == {"k": 1}
