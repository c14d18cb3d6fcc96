"""What is computed once stays computed once: scans, shuffled bytes and fits are counted."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulyze.functions import lookup
from tabulyze.functions.storage import discard, written
from tabulyze.operators import (
    cleaning, correlation, decision, features, forecast, kernel, quantiles, report, rules, segments, timeseries, typing)
from tabulyze.operators.facts import TableFacts
from tabulyze.plans.catalog import QUERIES
from tabulyze.sources.tables import Tables


class Work:
    """Sums over the stages that run inside the block."""

    def __init__(self, spark):
        self.spark = spark

    def _stages(self):
        sc = self.spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(
            None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    def __enter__(self):
        self.before = set(self._stages())
        return self

    def __exit__(self, *error):
        new = [s for i, s in self._stages().items() if i not in self.before]
        self.rows_read = sum(s.inputRecords() for s in new)
        self.shuffled = sum(s.shuffleWriteBytes() for s in new)


@pytest.fixture
def work(spark):
    return Work(spark)


@pytest.fixture(scope="module")
def orders(spark):
    return Tables(spark, "/root/testdata/sf0.01").orders


# ---------------------------------------------------------------- ranks

def counted_scans(monkeypatch, df, columns, probs, **limits):
    scans = []
    for name in ("_sketches", "_narrowed", "_picked"):
        plain = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, f=plain, n=name: (scans.append(n), f(*a))[1])
    out = quantiles.exact_quantiles(df, columns, probs, **limits)
    monkeypatch.undo()
    return out, scans


def test_scans_do_not_grow_with_columns_and_ranks(spark, monkeypatch):
    lineitem = Tables(spark, "/root/testdata/sf0.01").lineitem
    table = lineitem.toPandas()
    names = [c for c in table.columns if table[c].dtype.kind in "if"]
    few, once = counted_scans(monkeypatch, lineitem, names[:1], [0.5], pick_rows=300, accuracy=50)
    probs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95]
    many, again = counted_scans(monkeypatch, lineitem, names, probs, pick_rows=300, accuracy=50)
    assert "_narrowed" in again and again.count("_sketches") == 1
    assert len(again) <= len(once) + 1
    for c in names:
        assert many[c] == pytest.approx(list(table[c].astype(float).quantile(probs)), rel=1e-12)
    assert few[names[0]] == [table[names[0]].quantile(0.5)]


def test_a_wrong_sketch_is_found_out(spark, monkeypatch):
    df = spark.range(5000).selectExpr("cast(id as double) as x")
    def wrong(*a):
        return {"x": {"n": 5000, "min": 0.0, "max": 4999.0, "sketch": [1.0, 2.0]}}
    monkeypatch.setattr(quantiles, "_sketches", wrong)
    assert quantiles.exact_quantiles(df, ["x"], [0.5], pick_rows=100)["x"] == [2499.5]


def test_keys_keep_the_order_of_doubles():
    x = np.array([-math.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1e300, math.inf])
    keys = quantiles.ordered_key(x)
    assert (np.diff(keys) >= 0).all() and keys[4] == keys[5]
    assert list(quantiles.key_values(keys)) == list(x + 0.0)


# ---------------------------------------------------------------- shared facts

def test_dashboard_reads_the_table_six_times(orders, work):
    n, days = orders.count(), orders.select(F.to_date("o_orderdate")).distinct().count()
    with work:
        report.dashboard_context(orders).collect()
    assert work.rows_read <= 6 * n + 12 * days      # the days and segments are read again, the table is not


def test_shared_facts_change_nothing(orders, work):
    facts = TableFacts(orders)
    alone = [rules.executive_kpis(orders), rules.alerts(orders), report.dashboard_context(orders), typing.chart_flags(orders)]
    shared = [rules.executive_kpis(orders, facts), rules.alerts(orders, facts), report.dashboard_context(orders, facts),
              typing.chart_flags(orders, facts)]
    for a, b in zip(alone, shared):
        assert str(a.collect()) == str(b.collect())
    with work:
        for again in (rules.executive_kpis(orders, facts), report.dashboard_context(orders, facts), typing.chart_flags(orders, facts)):
            again.collect()
    assert work.rows_read < orders.count()
    found = facts.found
    assert facts.distinct_rows == kernel.row_counts(orders).first()["distinct_rows"]
    same = [(facts.segment_sums, segments.segment_sums(orders, found.segment, found.metric)),
            (facts.trend, timeseries.time_trend(orders, found.time, found.metric)),
            (facts.correlations().drop("a_ordinal", "b_ordinal"), correlation.correlation_pairs(orders, facts.numeric).drop("a_ordinal", "b_ordinal"))]
    for shared_frame, own in same:      # sums may come in another order
        pd.testing.assert_frame_equal(*[f.orderBy(f.columns[0]).toPandas() for f in (shared_frame, own)])
    target = "o_totalprice"
    drivers = {r["column"]: r for r in correlation.drivers_of(facts.pairs_of(target)).collect()}
    for r in correlation.key_drivers(orders, target).collect():
        assert drivers[r["column"]]["correlation"] == r["correlation"]
        assert drivers[r["column"]]["regression_coef"] == pytest.approx(r["regression_coef"])
    facts.close()


def test_opportunities_take_over_earlier_results(spark, work):
    part = Tables(spark, "/root/testdata/sf0.01").part
    facts, risks = TableFacts(part), rules.risk_watchlist(part)
    want = report.opportunity_context(part).first()
    assert report.opportunity_context(part, facts=facts, risks=risks).first() == want


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_facts_of_tiny_tables(spark, rows):
    df = spark.range(rows).selectExpr("id as n", "cast(null as double) as v", "cast(id as string) as s", "array(id) as a")
    if rows:
        assert rules.executive_kpis(df).count() == 1
        assert report.dashboard_context(df).count() == 1


# ---------------------------------------------------------------- staged fits

def test_series_are_fitted_once(spark, monkeypatch):
    fits = []
    plain = forecast.models
    monkeypatch.setattr(decision, "models", lambda frame: (fits.append(1), plain(frame))[1])
    staged = []
    put = decision.written
    monkeypatch.setattr(decision, "written", lambda df, name: (staged.append(name), put(df, name))[1])
    out = QUERIES["decision_scorecard"](spark, "/root/testdata/sf0.001")
    assert len(fits) == 1 and staged == ["fits", "risk"]
    text = out._jdf.queryExecution().toString()
    assert "orders" not in text       # the plan reads the written risks, not the table
    assert out.count() == 5


def test_written_frames_keep_names_and_types_and_go_when_discarded(spark):
    df = spark.sql("select 1 as `a b,(c)`, cast(2 as decimal(9, 2)) as `A B,(C)2`, timestamp_ntz'2024-01-01 10:00:00' as t, array(1, null) as x")
    kept = written(df)
    assert kept.dtypes == df.dtypes and kept.collect() == df.collect()
    discard(kept)
    with pytest.raises(Exception):
        kept.collect()
    assert written(spark.sql("select 1 as a, null as nothing")).first()["a"] == 1


# ---------------------------------------------------------------- dictionaries

def text_table(spark, rows=3000):
    return spark.range(rows).selectExpr("id", *[f"case when id % 17 = {i} then null else concat('v', id % {3 + i * 40}) end as t{i}" for i in range(8)],
                                        "if(id % 3 = 0, 'hot', concat('w', id)) as wide", "id % 2 = 0 as flag", "array(id % 5) as list")


def test_one_scan_counts_all_text_columns(spark, work, monkeypatch):
    table = text_table(spark)
    stored = written(table)
    names = ["t0", "t7", "wide", "flag"]
    want = {}
    pdf = table.toPandas()
    for c in names:
        want[c] = pdf[c].map(pdf[c].value_counts(normalize=True))
    with work:
        got = features.frequency_encode(stored).toPandas()
    dictionary = sum(pdf[c].astype(str).nunique() for c in [*[f"t{i}" for i in range(8)], "wide", "flag", "list"])
    assert work.rows_read <= 2 * 3000 + 12 * dictionary      # the table twice, its dictionary once a column
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 300)
    monkeypatch.setattr(lookup, "HOT_ROWS", 200)
    beyond = features.frequency_encode(stored).toPandas()
    assert list(beyond.columns) == list(got.columns)
    for frame in (got, beyond):
        frame = frame.sort_values("id", ignore_index=True)
        for c in names:
            pd.testing.assert_series_equal(frame[f"{c}_freq_enc"], want[c], check_names=False, check_dtype=False)


# ---------------------------------------------------------------- last values per column

@pytest.mark.parametrize("last", [False, True])
def test_sparse_columns_share_one_scan(spark, work, last):
    n = 4000
    columns = [f"c{i}" for i in range(50)]
    df = spark.range(n).selectExpr("id", "if(id % 11 = 0, double('NaN'), if(id % 13 = 0, null, id % 101)) as place",
                                   *[f"if(id % {400 + 7 * i} = {i}, id * 1.5D, null) as c{i}" for i in range(50)])
    stored = written(df.repartition(7))
    with work:
        got = kernel.edge_values(stored, columns, ["place", "id"], 3, last=last, probe_rows=20).collect()
    assert work.rows_read <= 5 * n       # the probe, what it saw, and one scan for all sparse columns
    rows = [r.asDict() for r in df.collect()]
    def place(r):     # nulls first, NaN behind all numbers
        p = r["place"]
        return (0 if p is None else 2 if math.isnan(p) else 1, 0 if p is None or math.isnan(p) else p, r["id"])
    rows.sort(key=place, reverse=last)
    for c in columns:
        want = [str(r[c]) for r in rows if r[c] is not None][:3]
        assert [r["v"] for r in sorted(got, key=lambda r: r["rn"]) if r["column"] == c] == want


# ---------------------------------------------------------------- row fingerprints

def test_counting_rows_shuffles_sixteen_bytes_a_row(spark, work):
    n = 20_000
    df = written(spark.range(n).selectExpr("id", *[f"cast(id * {i + 3} as string) as s{i}" for i in range(30)]))
    with work:
        assert kernel.row_counts(df).first()["distinct_rows"] == n
    assert work.shuffled < 40 * n
    with work:
        assert cleaning.dedupe(df).count() == n
    assert work.shuffled < 40 * n
    assert "Exchange" not in cleaning.dedupe(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_dedupe_equals_distinct(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", broadcast)
    nan = float("nan")
    rows = [(1, nan, "a", [1], "x"), (1, None, "a", [1], "x"), (1, 0.0, None, None, "x"), (1, -0.0, None, None, "x"), (None, 1.0, "a", [1], "x"),
            (1, None, "a", [1, None], "x"), (2, 5.0, "y" * 100, [], "x"), (2, 5.0, "y" * 100, [], "x"), (2, 5.0, "y" * 99, [], "x")] * 2
    df = spark.createDataFrame(rows, "i int, d double, s string, l array<int>, `odd name` string")
    got = cleaning.dedupe(df).collect()
    assert len(got) == 6 and len({str(r) for r in got}) == 6
    assert kernel.row_counts(df).first().asDict() == {"n_rows": 18, "distinct_rows": 6}
    ones = df.limit(1)
    assert cleaning.dedupe(ones).count() == 1 and cleaning.dedupe(df.where("false")).count() == 0


# ---------------------------------------------------------------- dates

DATES = {
    "2024-03-04": "2024-03-04 00:00:00", " 2024/3/4 ": "2024-03-04 00:00:00", "20240304": "2024-03-04 00:00:00",
    "2024-03-04T05:06": "2024-03-04 05:06:00", "2024-03-04 05:06:07.125": "2024-03-04 05:06:07.125000",
    "2024-03-04 05:06:07Z": "2024-03-04 05:06:07", "2024-03-04 05:06:07 +02:30": "2024-03-04 02:36:07",
    "2024-03-04T23:06:07-0130": "2024-03-05 00:36:07", "March 4, 2024": "2024-03-04 00:00:00", "Mar. 4 2024 1:05 PM": "2024-03-04 13:05:00",
    "4 mar 2024 12:30 am": "2024-03-04 00:30:00", "4-MAR-2024": "2024-03-04 00:00:00", "12/31/2024": "2024-12-31 00:00:00",
    "31.12.2024": None, "2024-13-01": None, "2024-02-30": None, "Foo 4, 2024": None, "2024": None, "": None, "|2024|01|02||||||||": None,
    "2024-03-04 25:00": None, "x" * 200: None, "2024-03-04 tomorrow": None, "03/04/2024 11:59:59 pm": "2024-03-04 23:59:59",
    "1234567": None, "12345678901": None}


def test_dates_of_every_spelling(spark):
    df = spark.createDataFrame([(t,) for t in DATES] + [(None,)], "t string")
    got = {r["t"]: r for r in df.select("t", typing.parse_datetime(F.col("t")).alias("m"),
                                        typing.parse_datetime(F.col("t"), day_first=True).alias("d")).collect()}
    want = {t: v and dt.datetime.fromisoformat(v) for t, v in DATES.items()} | {None: None}
    assert {t: r["m"] for t, r in got.items()} == want
    day_first = {"03/04/2024 11:59:59 pm": dt.datetime(2024, 4, 3, 23, 59, 59), "31.12.2024": dt.datetime(2024, 12, 31), "12/31/2024": None}
    assert {t: got[t]["d"] for t in want} == want | day_first


def test_a_cell_meets_one_date_pattern(spark):
    df = spark.createDataFrame([("2024-03-04",)], "t string")
    text = typing.promote_strict(df)._jdf.queryExecution().optimizedPlan().toString()
    # once to tell a date from another text, once to hand it on
    assert text.count(r"(\d{4})[-/]") <= 2
    many = spark.createDataFrame([(f"{d:02d}/{m:02d}/2024", "yes") for d in range(1, 29) for m in (1, 2)], "day string, x string")
    assert dict(typing.promote_strict(many).dtypes)["day"] == "timestamp_ntz"
    assert typing.promote_strict(many).agg(F.max("day")).first()[0] == dt.datetime(2024, 2, 28)


# ---------------------------------------------------------------- commonest texts and segments

@pytest.mark.parametrize("texts", [["x" * 64 + "b", "x" * 64 + "a", "x" * 64], ["x" * 64 + "b", "x" * 64 + "a"], ["y" * 70, "y" * 69, "z"],
                                   [None, None, "q"], ["é" * 80 + "b", "é" * 80 + "a"] * 2, ["#" + "a" * 64, "#" + "a" * 64, "b"]])
def test_long_texts_that_begin_alike(spark, texts):
    df = spark.createDataFrame([(t, "short") for t in texts], "t string, s string")
    got = {r["column"]: r for r in kernel.top_values(df).collect()}
    filled = [t for t in texts if t is not None]
    want = min(filled, key=lambda t: (-filled.count(t), t))
    assert (got["t"]["top_value"], got["t"]["top_n"], got["t"]["n_distinct"]) == (want, filled.count(want), len(set(filled)))
    assert got["s"]["top_value"] == "short" and got["s"]["top_n"] == len(texts)


def test_overall_figures_come_from_the_groups(spark, work):
    df = spark.range(3000).selectExpr("if(id % 7 = 0, null, id % 50) as s", "if(id % 11 = 0, null, id * id * 1.0D) as v")
    stored = written(df)
    with work:
        got = segments.segment_stats(stored, "s", "v").collect()
    assert work.rows_read <= 3000 + 12 * 60
    whole = df.selectExpr("round(avg(v), 4) as m", "round(stddev(v), 4) as d").first()
    assert len(got) == 10
    for r in got:
        assert (r["overall_mean"], r["overall_std"], r["total_segments"]) == (whole["m"], pytest.approx(whole["d"], rel=1e-9), 50)
    assert segments.segment_stats(df.where("false"), "s", "v").count() == 0
    nothing = segments.segment_stats(df.selectExpr("s", "cast(null as double) as v"), "s", "v").first()
    assert nothing["overall_mean"] is None and nothing["n"] == 0


def test_a_digest_of_one_row(spark):
    from tabulyze.operators import profiling
    lines = [r["line"] for r in profiling.dataset_digest(spark.sql("select true as a, 1 as b, cast(null as int) as c")).collect()]
    assert "Numbers: b about 1.00; c without values" in lines and "Values: a is most often 'true', 1 times" in lines
