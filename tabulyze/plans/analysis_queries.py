"""Distribution, segment, time-series and anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulyze.operators import anomalies as ano, distribution as dst, segments as seg, timeseries as tim
from tabulyze.plans.profile_queries import DL, LI, _fenced, _top_value
from tabulyze.plans.registry import LINEITEM_NUMERIC, register

# --- distributions ---------------------------------------------------------------------


def histogram_sql(table, c, bins):
    """Equal-width bins; ``bins`` is SQL over n, low, high, q1 and q3."""
    return f"""
      with e as (select count({c}) as n, min({c}) as low, max({c}) as high,
                   quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {table}),
      b as (select low, high, ({bins})::bigint as k from e),
      s as (select low, high, k, (high - low) / k as step from b),
      g as (select {c} as v, low, high, k, step,
              least(floor(({c} - low) / (high - low) * k), k - 1) as i from {table}, s where {c} is not null),
      g2 as (select *, i - case when v < low + i * step then 1 else 0 end as j from g),
      p as (select j + case when v >= low + (j + 1) * step and j < k - 1 then 1 else 0 end as bin from g2),
      c as (select bin::bigint as bin, count(*) as count from p group by 1),
      r as (select unnest(range((select k from b))) as bin),
      edges as (select r.bin, low + r.bin * step as low, case when r.bin = k - 1 then high
                  else low + (r.bin + 1) * step end as high from r, s)
      select edges.bin, low, high, (low + high) / 2 as mid, coalesce(c.count, 0) as count
      from edges left join c on edges.bin = c.bin"""


_AUTO = ("case when high = low then 1 else ceil((high - low) / case when q3 > q1 then "
         "least(2.0 * (q3 - q1) / pow(n, 1.0 / 3.0), (high - low) / (log2(n) + 1.0)) "
         "else (high - low) / (log2(n) + 1.0) end) end")


@register("histogram_auto", histogram_sql("events", "value", _AUTO), "low high mid")
def histogram_auto(t):
    return dst.histogram(t.events, "value")


@register("histogram_fixed", f"""
    select *, (select avg(l_extendedprice) from lineitem) as mean,
      (select quantile_cont(l_extendedprice, 0.5) from lineitem) as median
    from ({histogram_sql("lineitem", "l_extendedprice", "30")})""", "low high mid mean median")
def histogram_fixed(t):
    return dst.histogram(t.lineitem, "l_extendedprice", bins=30, markers=True)


@register("histogram_dashboard", histogram_sql("events", "value", "35"), "low high mid")
def histogram_dashboard(t):
    return dst.histogram(t.events, "value", bins=35)


@register("kde_curve", """
    with e as (select min(value) as low, max(value) as high, count(value) as n,
                 stddev_samp(value) * pow(count(value), -0.2) as h from events),
    g as (select i::int as point, low + i * (high - low) / 199 as x, h, n, (high - low) / 35 as w
          from e, (select unnest(range(200)) as i))
    select point, any_value(x) as x,
      sum(exp(-0.5 * pow((x - value) / h, 2))) / (any_value(h) * sqrt(2 * pi())) * any_value(w) as y
    from g, events group by point""", "x y")
def kde_curve(t):
    return dst.kde_curve(t.events, "value")


@register("frequency_table", "select event_type as value, count(*) as count from events_null group by 1")
def frequency_table(t):
    return dst.frequency_table(t.events_null, "event_type")


@register("box_stats", f"""
    select "column", q1, median, q3, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence,
      min, max, mean, std from (
        select col as "column", quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
          quantile_cont(v, 0.75) as q3, min(v) as min, max(v) as max, avg(v) as mean, stddev_samp(v) as std
        from ({LI}) group by col)""", "q1 median q3 lower_fence upper_fence min max mean std")
def box_stats(t):
    return dst.box_stats(t.lineitem)


def diagnostics_sql(long):
    return f"""
      select l.col, l.ordinal, coalesce(case when count(v) > 2 then skewness(v) end, 0) as skew,
        case when count(v) < 4 then 0 else max(f.outliers) * 100.0::double / count(v) end as pct,
        (count(*) - count(v)) * 100.0::double / count(*) as missing_pct
      from ({long}) l join ({_fenced(long)}) f on l.ordinal = f.ordinal group by l.col, l.ordinal"""


_CLASS = """case when abs(skew) > 2 then 'Highly skewed (' || case when skew > 0 then 'right' else 'left' end || ')'
    when abs(skew) > 1 then 'Moderately skewed (' || case when skew > 0 then 'right' else 'left' end || ')'
    when abs(skew) > 0.5 then 'Slightly skewed' else 'Approximately normal' end"""
_OUTLIER_RISK = "case when pct > 5 then 'High' when pct >= 1 then 'Moderate' else 'Low' end"
_SKEW_RISK = "case when abs(skew) > 1 then 'High' when abs(skew) > 0.5 then 'Moderate' else 'Low' end"


@register("distribution_class", f'select col as "column", {_CLASS} as distribution from ({diagnostics_sql(DL)})')
def distribution_class(t):
    return dst.distribution_classes(t.doc_labels)


@register("risk_class", f"""
    select col as "column", {_OUTLIER_RISK} as outlier_risk, {_SKEW_RISK} as skew_risk from ({diagnostics_sql(DL)})""")
def risk_class(t):
    return dst.risk_classes(t.doc_labels)


_DIAGNOSTICS = f"""
    select col as "column", 'numeric' as dtype, round(skew, 4) as skewness, round(pct, 2) as outlier_pct,
      {_CLASS} as distribution, round(missing_pct, 2) as missing_pct, {_OUTLIER_RISK} as outlier_risk,
      {_SKEW_RISK} as skew_risk, null::bigint as cardinality, null::double as dominance_pct
    from ({diagnostics_sql(DL)})"""
_TEXT_DIAGNOSTICS = " union all ".join(f"""
    select '{c}', 'categorical', null, null, null,
      round((select count(*) - count({c}) from doc_labels) * 100.0::double / (select count(*) from doc_labels), 2),
      null, null, (select count(distinct {c}) from doc_labels),
      round((select count(*) from doc_labels group by {c} order by 1 desc limit 1) * 100.0::double
            / (select count(*) from doc_labels), 2)""" for c in ("lang", "source"))


@register("column_diagnostics", f"{_DIAGNOSTICS} union all {_TEXT_DIAGNOSTICS}",
          "skewness outlier_pct missing_pct dominance_pct")
def column_diagnostics(t):
    return dst.column_diagnostics(t.doc_labels)


@register("column_diagnostic", f"{_DIAGNOSTICS} where col = 'n_chars'",
          "skewness outlier_pct missing_pct dominance_pct")
def column_diagnostic(t):
    return dst.column_diagnostic(t.doc_labels, "n_chars")


@register("most_skewed", f"""
    select col as "column", round(skew, 4) as skewness from ({diagnostics_sql(DL)})
    order by abs(round(skew, 4)) desc, ordinal limit 1""", "skewness")
def most_skewed(t):
    return dst.most_skewed(t.doc_labels)


@register("top_risk_columns", f"""
    select "column", outlier_risk, skew_risk, a + b as risk_rank from (
      select col as "column", ordinal, {_OUTLIER_RISK} as outlier_risk, {_SKEW_RISK} as skew_risk,
        case when pct > 5 then 2 when pct >= 1 then 1 else 0 end as a,
        case when abs(skew) > 1 then 2 when abs(skew) > 0.5 then 1 else 0 end as b from ({diagnostics_sql(DL)}))
    order by a + b desc, ordinal limit 3""")
def top_risk_columns(t):
    return dst.top_risk_columns(t.doc_labels)


# --- segments ----------------------------------------------------------------------------

def ranking_sql(table, segment, metric, order, top):
    return f"""
      select segment, value, round(value / greatest(sum(value) over (), 1e-9) * 100, 2) as share_pct
      from (select {segment} as segment, coalesce(sum({metric}), 0)::double as value from {table}
            where {segment} is not null group by 1) order by {order} limit {top}"""


@register("segment_ranking_top", ranking_sql("events", "event_type", "value", "value desc, segment", 10),
          "value share_pct")
def segment_ranking_top(t):
    return seg.segment_ranking(t.events, "event_type", "value")


@register("segment_ranking_bottom", ranking_sql("events", "event_type", "value", "value, segment desc", 10),
          "value share_pct")
def segment_ranking_bottom(t):
    return seg.segment_ranking(t.events, "event_type", "value", bottom=True)


@register("segment_ranking_nulls", ranking_sql("events_null", "event_type", "value", "value desc, segment", 10),
          "value share_pct")
def segment_ranking_nulls(t):
    return seg.segment_ranking(t.events_null, "event_type", "value")


@register("segment_custom", ranking_sql("lineitem", "l_partkey", "l_extendedprice", "value desc, segment", 25),
          "value share_pct")
def segment_custom(t):
    return seg.segment_ranking(t.lineitem, "l_partkey", "l_extendedprice", top=25)


@register("segment_stats", """
    with s as (select p_brand as segment, avg(p_retailprice) as mean, count(p_retailprice) as n,
                 stddev_samp(p_retailprice) as std from part group by 1),
    o as (select round(avg(p_retailprice), 4) as overall_mean, round(stddev_samp(p_retailprice), 4) as overall_std,
            (select count(*) from s) as total_segments from part)
    select side, segment, round(mean, 4) as avg, n, round(std, 4) as std_dev, overall_mean, overall_std, total_segments
    from (select * from (select 'top' as side, * from s order by mean desc, segment limit 5)
          union all select * from (select 'bottom' as side, * from s order by mean, segment desc limit 5)), o""",
          "avg std_dev overall_mean overall_std")
def segment_stats(t):
    return seg.segment_stats(t.part, "p_brand", "p_retailprice")


@register("segment_gap", """
    with s as (select p_brand as segment, round(avg(p_retailprice), 4) as avg from part group by 1),
    o as (select round(avg(p_retailprice), 4) as m from part)
    select segment, avg, round((avg - m) / m * 100, 1) as deviation_pct,
      max(avg) over () - min(avg) over () as gap, count(*) over () as total_segments,
      count(*) over () > 120 as too_many from s, o""", "avg deviation_pct gap")
def segment_gap(t):
    return seg.segment_gap(t.part, "p_brand", "p_retailprice")


@register("segment_share_other", """
    with s as (select p_brand as segment, sum(p_retailprice) as value from part group by 1),
    r as (select *, row_number() over (order by value desc, segment) as rn from s)
    select case when rn <= 10 then segment else 'Other' end as segment, sum(value) as value from r group by 1""",
          "value")
def segment_share_other(t):
    return seg.segment_share_other(t.part, "p_brand", "p_retailprice")


CONCENTRATION_SQL = """
    select round((hhi - 1.0 / k) / greatest(1.0 - 1.0 / k, 1e-9), 4) as concentration_risk,
      round(dominance, 2) as segment_dominance
    from (select sum(pow(share_pct / 100, 2)) as hhi, count(*) as k, arg_max(share_pct, value) as dominance
          from ({0}))"""


@register("segment_concentration", CONCENTRATION_SQL.format(
    ranking_sql("part", "p_brand", "p_retailprice", "value desc, segment", 10)),
    "concentration_risk segment_dominance")
def segment_concentration(t):
    return seg.segment_concentration(t.part, "p_brand", "p_retailprice")


@register("segment_top_value_share", " union all ".join(
    f"""select "column", ordinal, top_value, top_n, top_n::double / n as top_share from (
      select col as "column", ordinal, top_value, top_n, n from ({_top_value("events_null", c, i)}))"""
    for i, c in enumerate(["event_type"])), "top_share")
def segment_top_value_share(t):
    return seg.top_value_share(t.events_null)


_WEEK = ("strftime(date_trunc('week', {0}), '%Y-%m-%d') || '/' || "
         "strftime(date_trunc('week', {0}) + interval 6 day, '%Y-%m-%d')")


@register("performance_matrix", f"""
    select event_type as segment, {_WEEK.format("ts")} as period, sum(value) as value from events group by 1, 2""",
          "value")
def performance_matrix(t):
    return seg.performance_matrix(t.events, "event_type", "value", "ts")


@register("performance_matrix_quarters", """
    select o_orderpriority as segment, year(o_orderdate)::varchar || 'Q' || quarter(o_orderdate)::varchar as period,
      sum(o_totalprice) as value from orders group by 1, 2""", "value")
def performance_matrix_quarters(t):
    return seg.performance_matrix(t.orders, "o_orderpriority", "o_totalprice", "o_orderdate")


_WEEKS = [f"2024-{a}/2024-{b}" for a, b in (("01-01", "01-07"), ("01-08", "01-14"), ("01-15", "01-21"),
                                              ("01-22", "01-28"), ("01-29", "02-04"))]


@register("performance_matrix_wide", "select event_type as segment, " + ", ".join(
    f"sum(value) filter ({_WEEK.format('ts')} = '{w}') as \"{w}\"" for w in _WEEKS) + " from events group by 1",
          " ".join(_WEEKS))
def performance_matrix_wide(t):
    return seg.performance_matrix_wide(t.events, "event_type", "value", "ts")


# --- time series ---------------------------------------------------------------------------

EVENTS_DAILY = """
    select d.period, coalesce(s.value, 0) as value from (
      select unnest(generate_series((select min(ts)::date from events), (select max(ts)::date from events),
                                    interval 1 day))::date as period) d
    left join (select ts::date as period, sum(value) as value from events group by 1) s on d.period = s.period"""
ORDERS_MONTHLY = """
    select d.period, coalesce(s.value, 0) as value from (
      select last_day(unnest(generate_series((select date_trunc('month', min(o_orderdate)) from orders),
        (select max(o_orderdate) from orders), interval 1 month))::date) as period) d
    left join (select last_day(o_orderdate) as period, sum(o_totalprice) as value from orders group by 1) s
      on d.period = s.period"""
_ROLLED = """
    select period, value, round(avg(value) over (order by period rows between 2 preceding and current row), 4)
      as rolling_avg, '{freq}' as freq from ({series})"""


@register("time_trend", _ROLLED.format(freq="D", series=EVENTS_DAILY), "value rolling_avg")
def time_trend(t):
    return tim.time_trend(t.events, "ts", "value")


@register("time_trend_monthly", _ROLLED.format(freq="ME", series=ORDERS_MONTHLY), "value rolling_avg")
def time_trend_monthly(t):
    return tim.time_trend(t.orders, "o_orderdate", "o_totalprice")


@register("time_trend_weekly", _ROLLED.format(freq="W", series="""
    select d.period, coalesce(s.value, 0) as value from (
      select unnest(generate_series((select (date_trunc('week', min(o_orderdate)) + interval 6 day)::date from orders),
        (select (date_trunc('week', max(o_orderdate)) + interval 6 day)::date from orders), interval 7 day))::date
        as period) d
    left join (select (date_trunc('week', o_orderdate) + interval 6 day)::date as period, sum(o_totalprice) as value
               from orders group by 1) s on d.period = s.period"""), "value rolling_avg")
def time_trend_weekly(t):
    return tim.time_trend(t.orders, "o_orderdate", "o_totalprice", freq="W")


DIRECTION_SQL = """
    select first_value, last_value, periods, '{freq}' as freq, pct_change,
      case when pct_change > 2 then 'up' when pct_change < -2 then 'down' else 'flat' end as direction
    from (select first_value, last_value, periods,
            round((last_value - first_value) / greatest(abs(first_value), 1e-9) * 100, 2) as pct_change
          from (select arg_min(value, period) as first_value, arg_max(value, period) as last_value,
                  count(*) as periods from ({series})))"""


@register("trend_direction", DIRECTION_SQL.format(freq="D", series=EVENTS_DAILY), "first_value last_value pct_change")
def trend_direction(t):
    return tim.trend_direction(tim.time_trend(t.events, "ts", "value"))


ORDER_MEANS = """
    select *, row_number() over (order by period) - 1 as i from (
      select last_day(o_orderdate) as period, avg(o_totalprice) as value from orders group by 1)"""


TREND_STATS_SQL = f"""
    select periods_analysed, round(slope, 6) as trend_slope,
      case when slope > 0 then 'upward' else 'downward' end as trend_direction,
      round((last - first) / abs(first) * 100, 2) as total_pct_change, peak_period, trough_period,
      round(first, 4) as first_value, round(last, 4) as last_value
    from (select count(*) as periods_analysed, regr_slope(value, i) as slope, arg_min(value, i) as first,
            arg_max(value, i) as last, arg_max(period, value) as peak_period, arg_min(period, value) as trough_period
          from ({ORDER_MEANS}))"""


@register("trend_stats", TREND_STATS_SQL, "trend_slope total_pct_change first_value last_value")
def trend_stats(t):
    return tim.trend_stats(t.orders, "o_orderdate", "o_totalprice")


@register("trend_recent", f"""
    select period, round(value, 4) as value from ({ORDER_MEANS}) order by period desc limit 12""", "value")
def trend_recent(t):
    return tim.trend_recent(t.orders, "o_orderdate", "o_totalprice")


@register("event_counts_rolling", """
    select ts, count, avg(count) over (order by ts rows between 6 preceding and current row) as rolling_mean
    from (select ts, count(*) as count from events group by ts)""", "rolling_mean")
def event_counts_rolling(t):
    return tim.event_counts_rolling(t.events, "ts")


@register("event_counts_rolling_blocks", """
    select l_shipdate as ts, count, avg(count) over (order by l_shipdate rows between 6 preceding and current row)
      as rolling_mean from (select l_shipdate, count(*) as count from lineitem group by l_shipdate)""", "rolling_mean")
def event_counts_rolling_blocks(t):
    return tim.event_counts_rolling(t.lineitem, "l_shipdate", window_rows=0, block_rows=500)


def _spark_sql(c, i):
    return f"""
      select '{c}' as "column", 19 - (row_number() over (order by event_id desc) - 1) as pos, {c}::double as value
      from (select event_id, {c} from events_null where {c} is not null order by event_id desc limit 20)"""


_SPARKS = " union all ".join(f"({_spark_sql(c, i)})" for i, c in enumerate(["event_id", "value"]))


@register("sparkline_values", f'select "column", pos::int as pos, value from ({_SPARKS})', "value")
def sparkline_values(t):
    return tim.sparkline_values(t.events_null, ["event_id"])


@register("kpi_sparkline", f"""
    select "column", n_values, mean, last, case when first = 0 then 0 else (last - first) / abs(first) * 100 end
      as delta_pct from (select "column", count(*) as n_values, avg(value) as mean, arg_max(value, pos) as last,
        arg_min(value, pos) as first from ({_SPARKS}) group by 1)""", "mean last delta_pct")
def kpi_sparkline(t):
    return tim.kpi_sparkline(t.events_null, ["event_id"])


@register("trend_projection", f"""
    with p as (select *, row_number() over (order by period) - 1 as i from ({EVENTS_DAILY})),
    f as (select regr_slope(value, i) as slope, regr_intercept(value, i) as intercept, count(*) as n from p),
    r as (select sqrt(avg(pow(value - intercept - slope * i, 2))) as noise from p, f)
    select step::int as step, intercept + slope * (n + step - 1) as forecast,
      intercept + slope * (n + step - 1) - 1.5 * noise as lower,
      intercept + slope * (n + step - 1) + 1.5 * noise as upper
    from f, r, (select unnest(range(1, 7)) as step)""", "forecast lower upper")
def trend_projection(t):
    return tim.trend_projection(tim.time_trend(t.events, "ts", "value"))


# --- filters and anomalies --------------------------------------------------------------------

@register("non_null_series", "select value from events_null where value is not null", "value")
def non_null_series(t):
    return ano.non_null_rows(t.events_null, "value")


@register("complete_rows", "select * from events_null where value is not null and event_type is not null", "value")
def complete_rows(t):
    return ano.complete_rows(t.events_null, ["value", "event_type"])


@register("iqr_outlier_rows", """
    select events.* from events, (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
      from events) where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""", "value")
def iqr_outlier_rows(t):
    return ano.iqr_outlier_rows(t.events, "value")


@register("zscore_outlier_rows", """
    select events.*, abs(value - m) / s as z from events, (select avg(value) as m, stddev_pop(value) as s
      from events) where abs(value - m) / s > 3""", "value z")
def zscore_outlier_rows(t):
    return ano.zscore_outlier_rows(t.events, "value")


def _z_sql(table, columns, key, ddof="stddev_pop", min_n=10):
    return " union all ".join(f"""
      select {key} as key, '{c}' as "column", {i} as ordinal, {c}::double as value, abs({c} - m) / s as z
      from {table}, (select avg({c}) as m, {ddof}({c}) as s, count({c}) as n from {table})
      where n > {min_n} and abs({c} - m) / s > 3""" for i, c in enumerate(columns))


@register("anomaly_zscore", f"""
    select key, "column", value, z from ({_z_sql("documents", ["doc_id", "n_chars"], "doc_id")})""", "value z")
def anomaly_zscore(t):
    return ano.anomaly_rows(t.documents, "doc_id")


def counts_sql(table, columns):
    return " union all ".join(f"""
      select '{c}' as "column", {i} as ordinal, count(case when n > 10 and abs({c} - m) / s > 3 then 1 end) as count,
        count(*) as n_rows from {table}, (select avg({c}) as m, stddev_pop({c}) as s, count({c}) as n from {table})"""
                              for i, c in enumerate(columns))


@register("anomaly_counts", counts_sql("lineitem", LINEITEM_NUMERIC))
def anomaly_counts(t):
    return ano.anomaly_counts(t.lineitem)


def _summary_sql(hits, table, key):
    return f"""
      select h."column", count(*) as count,
        array_to_string((array_agg(round(value, 4) order by key))[1:5], '|') as sample_values,
        round(any_value(m), 4) as column_mean, round(any_value(s), 4) as column_std,
        round(count(*) * 100.0::double / any_value(n), 2) as pct_anomalous
      from ({hits}) h join (
        select 'event_id' as "column", avg(event_id) as m, stddev_samp(event_id) as s, count(event_id) as n from {table}
        union all select 'user_id', avg(user_id), stddev_samp(user_id), count(user_id) from {table}
        union all select 'value', avg(value), stddev_samp(value), count(value) from {table}) f
        on h."column" = f."column" group by h."column" """


_EVENT_NUMBERS = ["event_id", "user_id", "value"]
_Z_SUMMARY = _summary_sql(_z_sql("events", _EVENT_NUMBERS, "event_id", "stddev_samp", 3), "events", "event_id")
_IQR_HITS = " union all ".join(f"""
    select event_id as key, '{c}' as "column", {c}::double as value from events, (
      select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from events)
    where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)""" for c in _EVENT_NUMBERS)
_IQR_SUMMARY = _summary_sql(_IQR_HITS, "events", "event_id")


def _flat(df):
    return df.withColumn("sample_values", F.array_join("sample_values", "|"))


@register("anomaly_summary_z", _Z_SUMMARY, "column_mean column_std pct_anomalous")
def anomaly_summary_z(t):
    return _flat(ano.anomaly_summary(t.events, "event_id"))


@register("anomaly_summary_iqr", _IQR_SUMMARY, "column_mean column_std pct_anomalous")
def anomaly_summary_iqr(t):
    return _flat(ano.anomaly_summary(t.events, "event_id", method="iqr"))


@register("anomaly_totals", f"""
    select 'zscore' as method, coalesce(sum(count), 0)::bigint as total_anomalous_values,
      count(*) as columns_with_anomalies from ({_Z_SUMMARY})""")
def anomaly_totals(t):
    return ano.anomaly_totals(ano.anomaly_summary(t.events, "event_id"), "zscore")


@register("anomaly_bands", """
    select event_id as key, value, abs(value - m) / p > 3 as is_anomaly, m - 3 * s as lower_limit,
      m + 3 * s as upper_limit
    from events, (select avg(value) as m, stddev_pop(value) as p, stddev_samp(value) as s from events)""",
          "value lower_limit upper_limit")
def anomaly_bands(t):
    return ano.anomaly_bands(t.events, "value", "event_id")


@register("anomaly_pressure", f"""
    select least(sum(count)::double / max(n_rows), 1.0) as anomaly_pressure
    from ({counts_sql("events", _EVENT_NUMBERS)})""", "anomaly_pressure")
def anomaly_pressure(t):
    return ano.anomaly_pressure(t.events)


@register("anomaly_2sigma_share", """
    select avg(case when abs(value - m) > 2 * (s + 1e-9) then 1.0::double else 0 end) as share
    from events, (select avg(value) as m, stddev_pop(value) as s from events)""", "share")
def anomaly_2sigma_share(t):
    return ano.two_sigma_share(t.events, "value")


def watch_sql(table, columns):
    return " union all ".join(f"""
      select '{c}' as "column", {i} as ordinal, count(case when abs({c} - m) > 3 * s then 1 end) as n_anomalies,
        round(count(case when abs({c} - m) > 3 * s then 1 end) * 100.0::double / count({c}), 2) as pct,
        round(max(abs({c} - m) / s), 1) as max_z
      from {table}, (select avg({c}) as m, stddev_samp({c}) as s, count({c}) as n from {table})
      where n >= 4 and s > 0""" for i, c in enumerate(columns))


@register("anomaly_watch", f"""
    select "column", n_anomalies, pct, max_z from ({watch_sql("documents", ["doc_id", "n_chars"])})
    where n_anomalies > 0""", "pct max_z")
def anomaly_watch(t):
    return ano.anomaly_watch(t.documents)
