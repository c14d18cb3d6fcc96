"""Profiling, quality, descriptive and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulyze.operators import correlation as cor, descriptive as sta, profiling as prf, sketches as ske
from tabulyze.operators.kernel import distinct_profile
from tabulyze.plans.registry import (
    DOC_LABEL_NUMERIC, LINEITEM_NUMERIC, long_form, per_column, register)

LI = long_form("lineitem", LINEITEM_NUMERIC)
DL = long_form("doc_labels", DOC_LABEL_NUMERIC)
EVENTS_NULL = ["event_id", "ts", "value", "event_type"]
DOC_LABELS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
LINEITEM = LINEITEM_NUMERIC + ["l_returnflag", "l_linestatus", "l_shipdate"]
EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]

_LINEITEM_BYTES = "sum(8*3 + 4 + 8*4 + 8 + strlen(l_returnflag) + strlen(l_linestatus)) / (1024.0*1024.0)"


@register("schema_profile", f"""
    select count(*) as rows, 11 as columns,
      '{",".join(LINEITEM_NUMERIC)}' as numeric_columns, 'l_returnflag,l_linestatus' as categorical_columns,
      'l_shipdate' as datetime_columns, round({_LINEITEM_BYTES}, 4) as memory_usage_mb
    from lineitem""", "memory_usage_mb")
def schema_profile(t):
    return prf.schema_profile(t.lineitem)


@register("structure_summary", f"""
    select count(*) as rows, 11 as columns, 8 as numeric_columns, 2 as categorical_columns,
      1 as datetime_columns, round({_LINEITEM_BYTES}, 4) as memory_usage_mb from lineitem""", "memory_usage_mb")
def structure_summary(t):
    return prf.structure_summary(t.lineitem)


_MISSING = per_column("events_null", EVENTS_NULL, """
    select '{c}' as "column", {i} as ordinal, count(*) - count({c}) as missing_count,
      round((count(*) - count({c})) * 100.0::double / count(*), 2) as missing_pct from {t}""")


@register("missing_by_column", _MISSING, "missing_pct")
def missing_by_column(t):
    return prf.missing_by_column(t.events_null)


@register("missing_top", f"""
    select * from ({_MISSING}) where missing_count > 0 order by missing_pct desc, ordinal limit 12""",
          "missing_pct")
def missing_top(t):
    return prf.missing_by_column(t.events_null, only_missing=True, top=12)


_CARDINALITY = per_column("doc_labels", DOC_LABELS, """
    select '{c}' as "column", {i} as ordinal,
      count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as cardinality from {t}""")
_CARDINALITY_FILLED = per_column("doc_labels", DOC_LABELS, """
    select '{c}' as "column", {i} as ordinal, count(distinct {c}) as cardinality from {t}""")


@register("cardinality", _CARDINALITY)
def cardinality(t):
    return prf.cardinality(t.doc_labels)


@register("cardinality_filled", _CARDINALITY_FILLED)
def cardinality_filled(t):
    return prf.cardinality(t.doc_labels, count_null=False)


@register("cardinality_text", per_column("documents", ["doc_id", "text", "lang", "source", "n_chars"], """
    select '{c}' as "column", {i} as ordinal, count(distinct {c}) as cardinality from {t}"""))
def cardinality_text(t):
    return prf.cardinality(t.documents.select("doc_id", "text", "lang", "source", "n_chars"), count_null=False)


_TYPES = dict(zip(EVENTS, ["bigint", "timestamp_ntz", "bigint", "string", "double", "string"]))


@register("dtype_summary", " union all ".join(
    f"""select '{c}' as "column", {i} as ordinal, '{_TYPES[c]}' as dtype, count({c}) as filled from events"""
    for i, c in enumerate(EVENTS)))
def dtype_summary(t):
    return prf.dtype_summary(t.events)


def _missing_sql(table, columns):
    empty = " + ".join(f"count(*) - count({c})" for c in columns)
    return f"select ({empty}) as missing_cells, count(*) * {len(columns)} as cells from {table}"


@register("metadata_summary", f"""
    select (select round(avg(cardinality), 1) from ({_CARDINALITY_FILLED})) as avg_cardinality,
      (select round(missing_cells * 100.0::double / cells, 2) from ({_missing_sql("doc_labels", DOC_LABELS)}))
        as missing_density""", "avg_cardinality missing_density")
def metadata_summary(t):
    return prf.metadata_summary(t.doc_labels)


def _q_missing(table, columns):
    return f"(select missing_cells * 100.0::double / cells from ({_missing_sql(table, columns)}))"


def _q_duplicates(table):
    return (f"(select (n - d) * 100.0::double / n from (select (select count(*) from {table}) as n, "
            f"(select count(*) from (select distinct * from {table})) as d))")


def _fenced(long):
    """Per column: n_rows, n, q1, q3 and the IQR outlier count."""
    return f"""
      select l.ordinal, l.col, count(*) as n_rows, count(v) as n, any_value(q1) as q1, any_value(q3) as q3,
        count(case when v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1) then 1 end) as outliers
      from ({long}) l join (select ordinal, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3
                            from ({long}) group by ordinal) q on l.ordinal = q.ordinal
      group by l.ordinal, l.col"""


def _q_outliers(long):
    return f"(select sum(outliers) * 100.0::double / sum(n_rows) from ({_fenced(long)}))"


def _q_outliers_spread(long):
    return (f"(select sum(case when n >= 4 and q3 > q1 then outliers else 0 end) * 100.0::double "
            f"/ sum(case when n >= 4 and q3 > q1 then n else 0 end) from ({_fenced(long)}))")


def _q_outliers_n4(long):
    return (f"(select sum(case when n >= 4 and q3 > q1 then outliers else 0 end) * 100.0::double "
            f"/ sum(case when n >= 4 then n else 0 end) from ({_fenced(long)}))")


@register("quality_missing", f"select {_q_missing('doc_labels', DOC_LABELS)} as missing_pct", "missing_pct")
def quality_missing(t):
    return prf.quality_missing(t.doc_labels)


@register("quality_duplicates", f"select {_q_duplicates('events_dup')} as duplicate_pct", "duplicate_pct")
def quality_duplicates(t):
    return prf.quality_duplicates(t.events_dup)


@register("quality_outliers", f"select {_q_outliers(LI)} as outlier_pct", "outlier_pct")
def quality_outliers(t):
    return prf.quality_outliers(t.lineitem)


@register("quality_score_weighted", f"""
    select *, greatest(0.0, 100 - (0.5 * missing_pct + 0.3 * duplicate_pct + 0.2 * outlier_pct)) as quality_score
    from (select {_q_missing('doc_labels', DOC_LABELS)} as missing_pct,
                 {_q_duplicates('doc_labels')} as duplicate_pct, {_q_outliers(DL)} as outlier_pct)""",
          "missing_pct duplicate_pct outlier_pct quality_score")
def quality_score_weighted(t):
    return prf.quality_score_weighted(t.doc_labels)


@register("quality_score_app", f"""
    select round(missing_pct, 2) as missing_pct, round(duplicate_pct, 2) as duplicate_pct,
      round(outlier_pct, 2) as outlier_pct,
      round(greatest(0.0, 100 - missing_pct - duplicate_pct * 0.5 - outlier_pct * 0.3), 2) as quality_score
    from (select {_q_missing('doc_labels', DOC_LABELS)} as missing_pct,
                 {_q_duplicates('doc_labels')} as duplicate_pct, {_q_outliers_spread(DL)} as outlier_pct)""",
          "missing_pct duplicate_pct outlier_pct quality_score")
def quality_score_app(t):
    return prf.quality_score_app(t.doc_labels)


@register("quality_report", f"""
    select row_count, 6 as col_count, missing_pct, duplicate_pct, outlier_pct,
      round(100 - missing_pct, 2) as completeness_score, columns_with_missing
    from (select (select count(*) from doc_labels) as row_count,
      round({_q_missing('doc_labels', DOC_LABELS)}, 2) as missing_pct,
      round({_q_duplicates('doc_labels')}, 2) as duplicate_pct, round({_q_outliers_n4(DL)}, 2) as outlier_pct,
      (select {" + ".join(f"(count({c}) < count(*))::bigint" for c in DOC_LABELS)} from doc_labels)
        as columns_with_missing)""", "missing_pct duplicate_pct outlier_pct completeness_score")
def quality_report(t):
    return prf.quality_report(t.doc_labels)


_DL_MOMENTS = f"""
    select col, ordinal, avg(v) as mean, stddev_samp(v) as std, min(v) as min, max(v) as max,
      skewness(v) as skew, var_samp(v) as variance from ({DL}) group by col, ordinal"""


@register("dataset_profile", f"""
    select 'shape' as section, null::varchar as "column", 'rows' as metric,
      (select count(*) from doc_labels)::double as value
    union all select 'shape', null, 'columns', 6
    union all select 'shape', null, 'duplicate_pct', round({_q_duplicates('doc_labels')}, 2)
    union all select 'shape', null, 'missing_pct', round({_q_missing('doc_labels', DOC_LABELS)}, 2)
    union all select 'descriptive', col, metric, round(value, 4) from (
      unpivot (select col, mean, std, min, max, skew from ({_DL_MOMENTS})) on mean, std, min, max, skew
      into name metric value value)
    union all select 'primary_metric', col, 'variance', round(variance, 4) from (
      select * from ({_DL_MOMENTS}) order by variance desc, ordinal limit 1)
    union all select 'cardinality', 'lang', 'n_distinct', count(distinct lang) from doc_labels
    union all select 'cardinality', 'source', 'n_distinct', count(distinct source) from doc_labels""", "value")
def dataset_profile(t):
    return prf.dataset_profile(t.doc_labels)


@register("dataset_profile_mini", f"""
    select col as "column", count(*) as rows, 11 as columns, round(avg(v), 4) as mean
    from ({LI}) group by col""", "mean")
def dataset_profile_mini(t):
    return prf.mini_profile(t.lineitem)


def _pairs(table, columns):
    """(a, b, ao, bo, r) over pairwise-complete rows."""
    parts = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            parts.append(f"select '{a}' as a, '{b}' as b, {i} as ao, {j} as bo, "
                         f"corr({b}::double, {a}::double) as r from {table}")
    return f"select * from ({' union all '.join(parts)}) where r is not null and not isnan(r)"


def digest_sql(table, columns, numeric, others, moments, pairs):
    """The lines of a digest; ``others`` are the columns told by their commonest value."""
    commonest = " union all ".join(f"""select {i} as ordinal, '{c} is most often ''' || v || ''', ' || format('{{:,}}', n) || ' times' as part
        from (select {c}::varchar as v, count(*) as n from {table} where {c} is not null group by 1 order by n desc, v limit 1)"""
                                   for i, c in enumerate(others))
    return f"""
    select 1 as line_no, 'Table of ' || format('{{:,}}', count(*)) || ' rows and {len(columns)} columns' as line from {table}
    union all select 2, '{len(numeric)} number columns: {", ".join(numeric)}'
    union all select 3, '{len(others)} other columns: {", ".join(others)}'
    union all select 4, coalesce('Gaps: ' || string_agg(part, '; ' order by m desc, ordinal), 'Gaps: none') from (
      select *, printf('%s lacks %d (%.1f%%)', "column", m, m * 100.0 / n) as part from ({per_column(table, columns, '''
        select '{c}' as "column", {i} as ordinal, count(*) - count({c}) as m, count(*) as n from {t}''')}) where m > 0
      order by m desc, ordinal limit 4)
    union all select 5, 'Numbers: ' || string_agg(part, '; ' order by ordinal) from (
      select ordinal, printf('%s about %.2f, deviation %.2f', col, mean, std) as part from ({moments}))
    union all select 6, 'Strongest pairs: ' || string_agg(part, '; ' order by abs(r) desc, ao, bo) from (
      select *, printf('%s with %s %.2f', a, b, abs(r)) as part from ({pairs})
      order by abs(r) desc, ao, bo limit 4)
    union all select 7, 'Values: ' || string_agg(part, '; ' order by ordinal) from ({commonest})"""


@register("dataset_digest", digest_sql("doc_labels", DOC_LABELS, DOC_LABEL_NUMERIC, ["lang", "source"], _DL_MOMENTS,
                                       _pairs("doc_labels", DOC_LABEL_NUMERIC)))
def dataset_digest(t):
    return prf.dataset_digest(t.doc_labels)


_ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("dataset_digest_orders", digest_sql(
    "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], _ORDER_NUMBERS,
    ["o_orderstatus", "o_orderdate", "o_orderpriority"],
    f"select ordinal, col, avg(v) as mean, stddev_samp(v) as std from ({long_form('orders', _ORDER_NUMBERS)}) group by ordinal, col",
    _pairs("orders", _ORDER_NUMBERS)))
def dataset_digest_orders(t):
    # dates are told by their commonest value, too
    return prf.dataset_digest(t.orders)


# --- descriptive statistics ------------------------------------------------------------

@register("numerical_summary", f"""
    select col as "column", count(v) as count, avg(v) as mean, quantile_cont(v, 0.5) as median,
      stddev_samp(v) as std, var_samp(v) as variance, min(v) as min, max(v) as max, skewness(v) as skewness,
      kurtosis(v) as kurtosis, round((count(*) - count(v)) * 100.0 / count(*), 2)::double as missing_percentage
    from ({LI}) group by col""",
          "mean median std variance min max skewness kurtosis missing_percentage")
def numerical_summary(t):
    return sta.numerical_summary(t.lineitem)


@register("numerical_summary_nulls", f"""
    select col as "column", count(v) as count, avg(v) as mean, quantile_cont(v, 0.5) as median,
      stddev_samp(v) as std, var_samp(v) as variance, min(v) as min, max(v) as max, skewness(v) as skewness,
      kurtosis(v) as kurtosis, round((count(*) - count(v)) * 100.0 / count(*), 2)::double as missing_percentage
    from ({DL}) group by col""",
          "mean median std variance min max skewness kurtosis missing_percentage")
def numerical_summary_nulls(t):
    return sta.numerical_summary(t.doc_labels)


def _top_value(table, column, ordinal):
    return f"""
      select {ordinal} as ordinal, '{column}' as col, (select count(*) from {table}) as n_rows,
        (select count({column}) from {table}) as n, (select count(distinct {column}) from {table}) as n_distinct,
        top_value, top_n from (select {column} as top_value, count(*) as top_n from {table}
        where {column} is not null group by {column} order by top_n desc, top_value limit 1)"""


_CONVERSATIONS_TOP = " union all ".join(_top_value("conversations", c, i) for i, c in enumerate(["role", "text"]))
_EVENTS_NULL_TOP = _top_value("events_null", "event_type", 0)
_CATEGORICAL = """
    select col as "column", n as count, n_distinct as unique_count, top_value, top_n as top_frequency,
      round(top_n * 100.0 / n, 2)::double as top_percentage,
      round((n_rows - n) * 100.0 / n_rows, 2)::double as missing_percentage from ({0})"""


@register("categorical_summary", _CATEGORICAL.format(_CONVERSATIONS_TOP), "top_percentage missing_percentage")
def categorical_summary(t):
    return sta.categorical_summary(t.conversations)


@register("categorical_summary_nulls", _CATEGORICAL.format(_EVENTS_NULL_TOP), "top_percentage missing_percentage")
def categorical_summary_nulls(t):
    return sta.categorical_summary(t.events_null)


@register("shape_stats", f"""
    select col as "column", round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std,
      round(skewness(v), 4) as skew, round(kurtosis(v), 4) as kurtosis from ({LI}) group by col""",
          "mean std skew kurtosis")
def shape_stats(t):
    return sta.shape_stats(t.lineitem)


_DISTRIBUTION = """
    select l.col as "column", l.ordinal, round(avg(v), 6) as mean, round(quantile_cont(v, 0.5), 6) as median,
      round(stddev_samp(v), 6) as std, round(skewness(v), 4) as skew, round(kurtosis(v), 4) as kurtosis,
      round(quantile_cont(v, 0.05), 6) as p5, round(quantile_cont(v, 0.95), 6) as p95,
      max(case when f.q3 > f.q1 then f.outliers else 0 end) as outlier_count
    from ({0}) l join ({1}) f on l.ordinal = f.ordinal group by l.col, l.ordinal having count(v) > 3"""


@register("distribution_summary", _DISTRIBUTION.format(LI, _fenced(LI)), "mean median std skew kurtosis p5 p95")
def distribution_summary(t):
    return sta.distribution_summary(t.lineitem)


@register("skew_ranking", f"""
    select col as "column", round(skewness(v), 4) as skew from ({LI}) group by col, ordinal
    having count(v) > 3 order by abs(round(skewness(v), 4)) desc, ordinal limit 12""", "skew")
def skew_ranking(t):
    return sta.skew_ranking(t.lineitem, top=12)


@register("variance_summary", f"""
    select col as "column", round(var_samp(v), 4) as variance from ({LI}) group by col""", "variance")
def variance_summary(t):
    return sta.variance_summary(t.lineitem)


@register("report_descriptives", f"""
    select col as "column", ordinal, avg(v) as mean, stddev_samp(v) as std, min(v) as min, max(v) as max,
      quantile_cont(v, 0.5) as median from ({LI}) group by col, ordinal""", "mean std min max median")
def report_descriptives(t):
    return sta.report_descriptives(t.lineitem)


ORDERS_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]


def _kpi_sql(table, columns, key):
    parts = []
    for i, c in enumerate(columns):
        parts.append(f"""
          select '{c}' as "column", {i} as ordinal, avg({c}) as mean, quantile_cont({c}::double, 0.5) as median,
            stddev_samp({c}) as std, min({c})::double as min, max({c})::double as max,
            (arg_max({c}, {key}) filter ({c} is not null))::double as now,
            (select {c}::double from {table} where {c} is not null order by {key} desc limit 1 offset 1) as before
          from {table}""")
    return f"""select "column", ordinal, mean, median, std, min, max,
        case when before = 0 then null else (now / before - 1) * 100 end as pct_change_last
        from ({" union all ".join(parts)})"""


KPI_SQL = _kpi_sql("events_null", ["event_id", "value"], "event_id")


@register("kpi_by_column", KPI_SQL, "mean median std min max pct_change_last")
def kpi_by_column(t):
    return sta.kpi_by_column(t.events_null, ["event_id"])


@register("column_means_ranked", f"""
    select col as "column", avg(v) as mean from ({LI}) group by col order by mean desc limit 10""", "mean")
def column_means_ranked(t):
    return sta.column_means_ranked(t.lineitem)


# --- correlation -------------------------------------------------------------------------

LI_PAIRS = _pairs("lineitem", LINEITEM_NUMERIC)
DL_PAIRS = _pairs("doc_labels", DOC_LABEL_NUMERIC)


@register("corr_matrix", f"""
    with p as ({LI_PAIRS})
    select a, b, r from p union all select b, a, r from p
    union all select distinct c as a, c as b, 1.0::double as r from (select a as c from p union all select b from p)""",
          "r")
def corr_matrix(t):
    return cor.corr_matrix(t.lineitem)


@register("corr_strongest", f"""
    select a, b, round(r, 4) as r, rn <= 10 as is_top, abs(r) >= 0.75 as is_high
    from (select *, row_number() over (order by abs(r) desc, ao, bo) as rn from ({LI_PAIRS}))
    where rn <= 10 or abs(r) >= 0.75""", "r")
def corr_strongest(t):
    return cor.corr_strongest(t.lineitem)


@register("corr_top_diag", f"""
    select a as col_a, b as col_b, r as correlation from (select a, b, ao, bo, round(r, 4) as r from ({DL_PAIRS}))
    order by abs(r) desc, ao, bo limit 5""", "correlation")
def corr_top_diag(t):
    return cor.corr_top(t.doc_labels)


@register("corr_strongest_pair", f"""
    select a as col_a, b as col_b, r as correlation from (select a, b, ao, bo, round(r, 4) as r from ({DL_PAIRS}))
    order by abs(r) desc, ao, bo limit 1""", "correlation")
def corr_strongest_pair(t):
    return cor.corr_top(t.doc_labels, top=1)


CORR_LABELLED = """
    select a as feature_a, b as feature_b, r as correlation,
      case when abs(r) >= 0.8 then 'Very Strong' when abs(r) >= 0.6 then 'Strong'
           when abs(r) >= 0.4 then 'Moderate' when abs(r) >= 0.2 then 'Weak' else 'Negligible' end as strength
    from (select a, b, ao, bo, round(r, 4) as r from ({0})) order by abs(r) desc, ao, bo limit 15"""


@register("corr_labelled", CORR_LABELLED.format(LI_PAIRS), "correlation")
def corr_labelled(t):
    return cor.corr_labelled(t.lineitem)


_HEAT = ",\n".join(f"max(case when b = '{c}' then r else 0 end) + min(case when b = '{c}' then r else 0 end) as {c}"
                   for c in DOC_LABEL_NUMERIC)


@register("corr_heatmap", f"""
    with p as (select a, b, round(r, 4) as r from ({DL_PAIRS}))
    select a as feature, {_HEAT} from (
      select a, b, r from p union all select b, a, r from p
      union all select distinct c as a, c as b, 1.0::double from (select a as c from p union all select b from p))
    group by a""", " ".join(DOC_LABEL_NUMERIC))
def corr_heatmap(t):
    return cor.corr_heatmap(t.doc_labels)


@register("corr_top_abs", f"""
    select a as col_a, b as col_b, round(abs(r), 4) as abs_r from ({LI_PAIRS})
    order by abs(r) desc, ao, bo limit 5""", "abs_r")
def corr_top_abs(t):
    return cor.corr_top_abs(t.lineitem)


# A frame with derived columns, so that near-copies exist.
_PRICED = """(select l_quantity, l_extendedprice, l_discount,
    l_extendedprice * (1 - l_discount) as revenue, l_extendedprice * (1 + l_tax) as charge from lineitem) priced"""
_PRICED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "revenue", "charge"]


@register("multicollinearity", f"""
    select a, b, round(abs(r), 4) as abs_r from ({_pairs(_PRICED, _PRICED_COLUMNS)}) where abs(r) > 0.92""", "abs_r")
def multicollinearity(t):
    return cor.multicollinearity(t.lineitem.selectExpr(
        "l_quantity", "l_extendedprice", "l_discount", "l_extendedprice * (1 - l_discount) as revenue",
        "l_extendedprice * (1 + l_tax) as charge"))


def drivers_sql(table, columns, target):
    parts = " union all ".join(
        f"select '{c}' as \"column\", {i} as ordinal, corr({target}::double, {c}::double) as r, "
        f"regr_slope({target}::double, {c}::double) as slope from {table} "
        f"having count(case when {c} is not null and {target} is not null then 1 end) >= 2"
        for i, c in enumerate(c for c in columns if c != target))
    return f"""
      select "column", ordinal, round(r, 4) as correlation, round(abs(r), 4) as abs_correlation,
        round(coalesce(slope, 0), 6) as regression_coef,
        case when r >= 0 then 'positive' else 'negative' end as direction from ({parts})"""


@register("key_drivers", f"""
    select * exclude ordinal from ({drivers_sql("lineitem", LINEITEM_NUMERIC, "l_extendedprice")})""",
          "correlation abs_correlation regression_coef")
def key_drivers(t):
    return cor.key_drivers(t.lineitem, "l_extendedprice")


@register("driver_summary", f"""
    select "column", correlation, direction,
      trunc(abs_correlation / max(abs_correlation) over () * 100)::int as bar_width,
      row_number() over (order by abs_correlation desc, "column") <= 6 as in_summary
    from ({drivers_sql("lineitem", LINEITEM_NUMERIC, "l_extendedprice")})""", "correlation")
def driver_summary(t):
    return cor.driver_summary(t.lineitem, "l_extendedprice")


@register("ols_line", """
    select step::int as step, low + step * (high - low) / 99 as x,
      intercept + slope * (low + step * (high - low) / 99) as fit, slope, intercept, n
    from (select regr_slope(l_extendedprice, l_quantity) as slope,
            regr_intercept(l_extendedprice, l_quantity) as intercept,
            min(l_quantity) as low, max(l_quantity) as high, count(*) as n from lineitem),
         (select unnest(range(100)) as step)""", "x fit slope intercept")
def ols_line(t):
    return cor.ols_line(t.lineitem, "l_quantity", "l_extendedprice")


@register("scatter_points", """
    select event_id as key, n_rank as x, value as y, event_type as colour, false as too_many_colours
    from (select event_id, user_id::double as n_rank, value, event_type from events)
    where value is not null""", "x y")
def scatter_points(t):
    return cor.scatter_points(t.events, "user_id", "value", colour="event_type", key="event_id")


@register("scatter_matrix", """
    select o_orderkey as key, o_orderkey::double as o_orderkey, o_custkey::double as o_custkey,
      o_totalprice from orders""", "o_orderkey o_custkey o_totalprice")
def scatter_matrix(t):
    return cor.scatter_matrix(t.orders, "o_orderkey")


# --- distinct states ---------------------------------------------------------------------

@register("distinct_states", per_column("events", ["event_id", "user_id", "event_type", "value", "props"], """
    select {i} as ordinal, '{c}' as "column", count(*) as n_rows, count({c}) as n, count(distinct {c}) as exact, true as within from {t}"""))
def distinct_states(t):
    # one state per day and column; the days are united without reading their rows again
    days = t.events.withColumn("day", F.to_date("ts")).drop("ts")
    found = ske.estimated(ske.united(ske.distinct_states(days, "day")))
    exact = distinct_profile(days.drop("day")).select("column", F.col("n_distinct").alias("exact"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * ske.relative_error())
    return found.join(F.broadcast(exact), "column").select("ordinal", "column", "n_rows", "n", "exact", near.alias("within"))   # one row per column
