"""Source, typing, cleaning and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulyze.functions.columns import require_rows
from tabulyze.functions.storage import scratch_path
from tabulyze.operators import cleaning as cln, features as fea, typing as typ
from tabulyze.plans.profile_queries import (
    DL, LI, _fenced, _missing_sql, _q_duplicates, _q_missing, _q_outliers_spread)
from tabulyze.plans.registry import LINEITEM_NUMERIC, long_form, per_column, register
from tabulyze.sources.csv_files import preview as preview_rows, read_csv


# --- sources -------------------------------------------------------------------------

@register("csv_scan", """
    select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer""", "c_acctbal")
def csv_scan(t):
    path = scratch_path(t.spark, "csv-scan")
    t.customer.write.option("header", True).csv(path)
    out = read_csv(t.spark, path)
    return out.withColumn("c_custkey", F.col("c_custkey").cast("long")).withColumn(
        "c_nationkey", F.col("c_nationkey").cast("long"))


@register("validate", "select count(*) as rows, 6 as columns, count(*) > 0 as valid from events")
def validate(t):
    events = require_rows(t.events)
    return events.agg(F.count("*").alias("rows"), F.lit(len(events.columns)).alias("columns"),
                      (F.count("*") > 0).alias("valid"))


@register("preview", "select * from orders order by o_orderkey limit 20", "o_totalprice")
def preview(t):
    return preview_rows(t.orders, ["o_orderkey"], 20)


@register("preview_short", "select * from orders order by o_orderkey limit 5", "o_totalprice")
def preview_short(t):
    return preview_rows(t.orders, ["o_orderkey"], 5)


@register("parquet_scan", "select l_orderkey, l_quantity, l_shipdate from lineitem", "l_quantity")
def parquet_scan(t):
    return t.lineitem.select("l_orderkey", "l_quantity", "l_shipdate")


# --- typing ---------------------------------------------------------------------------

@register("type_promote_strict", """
    select o_orderkey, cast(custkey_s as bigint) as custkey_s, price_s, order_date from orders_text""")
def type_promote_strict(t):
    return typ.promote_strict(t.orders_text)


@register("type_promote_majority", """
    select o_orderkey, cast(custkey_s as bigint) as custkey_s, try_cast(price_s as double) as price_s,
      try_cast(order_date as timestamp) as order_date from orders_text""", "price_s")
def type_promote_majority(t):
    return typ.promote_majority(t.orders_text)


@register("type_promote_datetime_hint", """
    select o_orderkey, custkey_s, price_s, try_cast(order_date as timestamp) as order_date from orders_text""")
def type_promote_datetime_hint(t):
    return typ.promote_datetime_hint(t.orders_text)


_EVENT_CLASSES = {"event_id": "numeric", "ts": "datetime", "user_id": "numeric", "event_type": "categorical",
                  "value": "numeric", "props": "categorical"}


@register("column_classes", " union all ".join(
    f"""select '{c}' as "column", {i} as ordinal, '{k}' as class, count({c}) as filled from events"""
    for i, (c, k) in enumerate(_EVENT_CLASSES.items())))
def column_classes(t):
    return typ.column_classes(t.events)


_EMBEDDING_CLASSES = {"vec_id": "numeric", "embedding": "categorical", "label": "numeric"}


@register("column_classes_rest", " union all ".join(
    f"""select '{c}' as "column", {i} as ordinal, '{k}' as class, count({c}) as filled from embeddings"""
    for i, (c, k) in enumerate(_EMBEDDING_CLASSES.items())))
def column_classes_rest(t):
    return typ.column_classes(t.embeddings, rest_is_categorical=True)


# Column kinds of each table, as the oracle needs them: i integer, f real, s text, t datetime.
KINDS = {
    "customer": {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "f", "c_mktsegment": "s"},
    "part": {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "f"},
    "doc_labels": {"doc_id": "i", "lang": "s", "source": "s", "n_chars": "i", "quality": "i", "toxic": "i"},
    "events": {"event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "value": "f", "props": "s"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "f",
               "o_orderdate": "t", "o_orderpriority": "s"},
    "documents": {"doc_id": "i", "text": "s", "lang": "s", "source": "s", "n_chars": "i"},
    "embeddings": {"vec_id": "i", "embedding": "o", "label": "i"},
    "lineitem": {**{c: "i" for c in LINEITEM_NUMERIC[:4]}, **{c: "f" for c in LINEITEM_NUMERIC[4:]},
                 "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"},
}
_TYPE_NAMES = {"t": "timestamp_ntz", "s": "string", "f": "double", "o": "array<float>"}
_INTS = {"label": "int", "c_nationkey": "int", "p_size": "int", "quality": "int", "toxic": "int", "l_linenumber": "int"}


def roles_sql(table):
    """Role facts and rules per column."""
    parts = []
    for i, (c, k) in enumerate(KINDS[table].items()):
        truthy = {"s": f"{c} in ('0','1','yes','no','true','false','Yes','No','True','False')",
                  "t": "false", "o": "false"}.get(k, f"{c} in (0, 1)")
        dtype = _TYPE_NAMES.get(k) or _INTS.get(c, "bigint")
        length = f"avg(length({c}))" if k == "s" else "null::double"
        parts.append(f"""
          select '{c}' as "column", {i} as ordinal, '{dtype}' as dtype_raw, '{k}' as kind,
            count(*) as n_rows, count({c}) as n, {"null" if k == "o" else f"count(distinct {c})"} as n_distinct, {length} as avg_len,
            coalesce(bool_and({truthy}), true) as all_truthy from {table}""")
    seg = typ.SEGMENT_NAMES
    return f"""
      select "column", ordinal, dtype_raw,
        case when kind = 't' then 'datetime' when kind = 'o' then 'text'
          when all_truthy and n_distinct <= 2 then 'boolean'
          when kind = 'i' and n = n_rows and (is_id or ratio >= 0.85) then 'id'
          when kind in ('i', 'f') then 'numeric'
          when is_id or ratio >= 0.85 then 'id'
          when avg_len > 20 and n_distinct > 100 then 'text'
          when n_distinct <= 50 or is_segment then 'categorical' else 'text' end as role,
        n_distinct as cardinality, round((n_rows - n) * 100.0::double / n_rows, 2) as missing_pct,
        (n_rows - n)::double / n_rows as missing_share, n_rows, n as filled
      from (select *, n_distinct::double / n_rows as ratio,
              regexp_matches("column", '{typ.ID_NAMES}', 'i') as is_id,
              regexp_matches("column", '{seg}', 'i') as is_segment
            from ({" union all ".join(parts)}))"""


def metric_sql(table):
    numeric = [c for c, k in KINDS[table].items() if k in "if"]
    stats = per_column(table, numeric, """
        select '{c}' as "column", count({c}) as n, avg({c}::double) as mean, stddev_samp({c}::double) as std from {t}""")
    return f"""
      select r."column", case when regexp_matches(r."column", '{typ.METRIC_NAMES}', 'i') then 3.0::double else 0 end
          + least(coalesce(std / (mean + 1e-9), 0), 2.0) - missing_share * 2.0 as score
      from ({roles_sql(table)}) r join ({stats}) s on r."column" = s."column"
      where role = 'numeric' and n > 0 order by score desc, ordinal limit 1"""


def segment_sql(table):
    return f"""
      select "column", case when regexp_matches("column", '{typ.SEGMENT_NAMES}', 'i') then 3.0::double else 0 end
          + case when cardinality between 2 and 30 then 2.0 when cardinality > 30 then -1.0 else 0 end
          - missing_share * 2.0 as score
      from ({roles_sql(table)}) where role = 'categorical' order by score desc, ordinal limit 1"""


def _register_roles(table):
    name = "column_roles" if table == "lineitem" else f"column_roles_{table}"

    @register(name, roles_sql(table), "missing_pct missing_share")
    def run(t, table=table):
        return typ.column_roles(getattr(t, table))


for _table in ("lineitem", "customer", "part", "doc_labels", "documents", "events"):
    _register_roles(_table)


@register("column_roles_nested", roles_sql("embeddings"), "missing_pct missing_share")
def column_roles_nested(t):
    return typ.column_roles(t.embeddings)


def samples_sql(table, columns, order):
    return " union all ".join(f"""
      select '{c}' as "column", string_agg(cell, '|' order by place) as samples
      from (select {c}::varchar as cell, {order} as place from {table} where {c} is not null order by {order} limit 5)""" for c in columns)


@register("column_samples", samples_sql("customer", list(KINDS["customer"]), "c_custkey"))
def column_samples(t):
    return typ.column_samples(t.customer, ["c_custkey"]).withColumn("samples", F.array_join("samples", "|"))


@register("column_samples_sparse", samples_sql("doc_labels", list(KINDS["doc_labels"]), "doc_id"))
def column_samples_sparse(t):
    return typ.column_samples(t.doc_labels, ["doc_id"]).withColumn("samples", F.array_join("samples", "|"))


@register("infer_primary_metric", metric_sql("events"), "score")
def infer_primary_metric(t):
    return typ.infer_primary_metric(t.events)


@register("infer_segment", segment_sql("orders"), "score")
def infer_segment(t):
    return typ.infer_segment(t.orders)


@register("infer_time", f"""
    select arg_min("column", ordinal) filter (role = 'datetime') as time_col,
      bool_or(role = 'datetime') and bool_or(role = 'numeric') as has_time_series from ({roles_sql("orders")})""")
def infer_time(t):
    return typ.infer_time(t.orders)


@register("target_by_variance", f"""
    select col as "column", var_samp(v) as variance from ({LI}) group by col, ordinal
    order by variance desc, ordinal limit 1""", "variance")
def target_by_variance(t):
    return typ.target_by_variance(t.lineitem)


_SUITABILITY = """
    select {cat} and {num} and n >= 50 as classification_ready, {num} and n >= 50 as regression_ready,
      {many} and n >= 50 as clustering_ready, {time} and n >= 30 as time_series_ready,
      {num} as has_numeric_features, {cat} as has_categorical_features, {time} as has_datetime_column,
      n >= 50 as sufficient_rows, '{targets}' as target_candidate_columns
    from (select count(*) as n from {table})"""


def _joined_targets(df):
    return df.withColumn("target_candidate_columns", F.array_join("target_candidate_columns", ","))


@register("suitability", _SUITABILITY.format(
    cat="true", num="true", many="true", time="true", table="events",
    targets="event_type,props,event_id,user_id,value"))
def suitability(t):
    return _joined_targets(typ.suitability(t.events))


@register("suitability_small", _SUITABILITY.format(
    cat="true", num="true", many="true", time="false", table="nation", targets="n_name,n_nationkey,n_regionkey"))
def suitability_small(t):
    return _joined_targets(typ.suitability(t.nation))


@register("use_case_rules", f"""
    select rule, use_case from (
      select 1 as rule, 'predicting and projecting a number' as use_case, true as applies
      union all select 2, 'telling classes apart', true
      union all select 3, 'grouping similar rows', (select count(*) from doc_labels) > 1000
      union all select 4, 'finding odd values', round({_q_outliers_spread(DL)}, 2) > 2
      union all select 5, 'summary views', true) where applies""")
def use_case_rules(t):
    return typ.use_case_rules(t.doc_labels)


@register("dataset_tags", """
    select 'financial / sales' as domain, 'moderate' as complexity, count(*) as rows, 11 as columns from lineitem""")
def dataset_tags(t):
    return typ.dataset_tags(t.lineitem)


# --- cleaning ----------------------------------------------------------------------------

@register("impute_median_unknown", """
    select event_id::bigint as event_id, ts,
      coalesce(value, (select quantile_cont(value, 0.5) from events_null)) as value,
      coalesce(event_type, 'Unknown') as event_type from events_null""", "value")
def impute_median_unknown(t):
    return cln.impute_median_unknown(t.events_null)


@register("impute_median_mode", """
    select event_id, ts, coalesce(value, (select quantile_cont(value, 0.5) from events_null)) as value,
      coalesce(event_type, (select event_type from events_null where event_type is not null group by event_type
        order by count(*) desc, event_type limit 1)) as event_type from events_null""", "value")
def impute_median_mode(t):
    return cln.impute_median_mode(t.events_null)


@register("dedupe", "select distinct * from events_dup")
def dedupe(t):
    return cln.dedupe(t.events_dup)


def _capped(table, columns, keep):
    fences = ", ".join(
        f"quantile_cont({c}::double, 0.25) as {c}_q1, quantile_cont({c}::double, 0.75) as {c}_q3, count({c}) as {c}_n"
        for c in columns)
    capped = ", ".join(f"""
        case when {c}_q3 > {c}_q1 and {c}_n >= 4 and {c} is not null
          then least(greatest({c}::double, {c}_q1 - 1.5 * ({c}_q3 - {c}_q1)), {c}_q3 + 1.5 * ({c}_q3 - {c}_q1))
          else {c}::double end as {c}""" for c in columns)
    rest = "".join(f", {c}" for c in keep)
    return f"select {capped}{rest} from {table}, (select {fences} from {table}) fences"


@register("cap_outliers", _capped("lineitem", LINEITEM_NUMERIC, ["l_returnflag", "l_linestatus", "l_shipdate"]),
          " ".join(LINEITEM_NUMERIC))
def cap_outliers(t):
    return cln.cap_outliers(t.lineitem)


@register("cap_outliers_skewed", _capped("doc_labels", ["doc_id", "n_chars"], ["lang", "source", "quality", "toxic"]), "doc_id n_chars")
def cap_outliers_skewed(t):
    return cln.cap_outliers(t.doc_labels)


_EVENTS_NULL_LONG = long_form("events_null", ["event_id", "value"])


@register("cleaning_dry_run", f"""
    select (select count(*) from events_null) as rows_before,
      (select count(*) from (select distinct * from events_null)) as rows_after_duplicates_removed,
      (select missing_cells from ({_missing_sql("events_null", ["event_id", "ts", "value", "event_type"])}))
        as missing_values_to_fill,
      (select sum(case when n >= 4 and q3 > q1 then outliers else 0 end)::bigint
         from ({_fenced(_EVENTS_NULL_LONG)})) as outlier_values_to_cap""")
def cleaning_dry_run(t):
    return cln.cleaning_dry_run(t.events_null)


_STRICT_STAGES = """
    (select distinct * from (
      select coalesce(user_s::double, (select quantile_cont(user_s::double, 0.5) from events_dirty)) as user_s,
        coalesce(event_type, 'Unknown') as event_type, band::double as band,
        event_date::timestamp as event_date from events_dirty))"""


@register("clean_strict",
          _capped(f"{_STRICT_STAGES} stages", ["user_s", "band"], ["event_type", "event_date"]), "user_s band")
def clean_strict(t):
    return cln.clean_strict(t.events_dirty)


_APP_CLEANED = """
    with distinct_rows as (select distinct * from events_dirty)
    select coalesce(user_s::double, (select quantile_cont(user_s::double, 0.5) from distinct_rows)) as user_s,
      coalesce(event_type, (select event_type from distinct_rows where event_type is not null group by event_type
        order by count(*) desc, event_type limit 1)) as event_type, band,
      event_date::timestamp as event_date from distinct_rows"""


@register("clean_app", _APP_CLEANED, "user_s")
def clean_app(t):
    return cln.clean_app(t.events_dirty)


def _app_metrics(table, columns, numeric):
    long = long_form(table, numeric)
    return f"""
      select round(missing_pct, 2) as missing_pct, round(duplicate_pct, 2) as duplicate_pct,
        round(outlier_pct, 2) as outlier_pct,
        round(greatest(0.0, 100 - missing_pct - duplicate_pct * 0.5 - outlier_pct * 0.3), 2) as quality_score
      from (select {_q_missing(table, columns)} as missing_pct, {_q_duplicates(table)} as duplicate_pct,
                   {_q_outliers_spread(long)} as outlier_pct)"""


_DIRTY = ["user_s", "event_type", "band", "event_date"]


@register("quality_before_after", f"""
    select metric, before, after, delta,
      case when abs(delta) < 0.005 then 'no change' when (delta < 0) = (metric <> 'quality_score') then 'improved'
        else 'worse' end as verdict
    from (select b.metric, before, after, round(after - before, 2) as delta
      from (unpivot ({_app_metrics("events_dirty", _DIRTY, ["band"])})
              on missing_pct, duplicate_pct, outlier_pct, quality_score into name metric value before) b
      join (unpivot ({_app_metrics("events_clean", _DIRTY, ["user_s", "band"])})
              on missing_pct, duplicate_pct, outlier_pct, quality_score into name metric value after) a
        on a.metric = b.metric)""".replace("events_clean", f"({_APP_CLEANED})"), "before after delta")
def quality_before_after(t):
    return cln.quality_before_after(t.events_dirty)


# --- features ------------------------------------------------------------------------------

def _parts(c):
    return (f"year({c})::int as {c}_year, month({c})::int as {c}_month, (isodow({c}) - 1)::int as {c}_weekday, "
            f"quarter({c})::int as {c}_quarter")


@register("feat_datetime_parts", f"""
    select *, {_parts("o_orderdate")} from orders""")
def feat_datetime_parts(t):
    return fea.datetime_parts(t.orders)


def _z(columns):
    return ", ".join(f"({c} - avg({c}) over ()) / stddev_samp({c}) over () as {c}_zscore" for c in columns)


@register("feat_zscore", f"select *, {_z(LINEITEM_NUMERIC)} from lineitem",
          " ".join(f"{c}_zscore" for c in LINEITEM_NUMERIC) + " l_quantity l_extendedprice l_discount l_tax")
def feat_zscore(t):
    return fea.zscores(t.lineitem)


@register("feat_log1p", """
    select *, ln(1 + o_totalprice) as o_totalprice_log from orders""",
          "o_totalprice o_totalprice_log")   # both keys start at 0
def feat_log1p(t):
    return fea.log1p_columns(t.orders)


@register("feat_freq_enc", """
    select *, case when event_type is not null then
      count(event_type) over (partition by event_type)::double / count(event_type) over () end as event_type_freq_enc
    from events_null""", "event_type_freq_enc")
def feat_freq_enc(t):
    return fea.frequency_encode(t.events_null)


_ORDER_PARTS = ["o_orderdate_year", "o_orderdate_month", "o_orderdate_weekday", "o_orderdate_quarter"]
_ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"] + _ORDER_PARTS


def _logs(columns):
    return ", ".join(f"ln(1 + {c}) as {c}_log" for c in columns)


def _freqs(columns):
    return ", ".join(f"count(*) over (partition by {c})::double / count(*) over () as {c}_freq_enc" for c in columns)


# both keys and Monday start at 0
_ORDER_LOGGED = ["o_totalprice", "o_orderdate_year", "o_orderdate_month", "o_orderdate_quarter"]


@register("feat_all", f"""
    with parts as (select *, {_parts("o_orderdate")} from orders)
    select *, {_z(_ORDER_NUMBERS)}, {_logs(_ORDER_LOGGED)}, {_freqs(["o_orderstatus", "o_orderpriority"])} from parts""",
          " ".join([f"{c}_zscore" for c in _ORDER_NUMBERS] + [f"{c}_log" for c in _ORDER_LOGGED]
                   + ["o_totalprice", "o_orderstatus_freq_enc", "o_orderpriority_freq_enc"]))
def feat_all(t):
    return fea.all_features(t.orders)


_PLAN = """
    select 'event_id' as "column", 0 as ordinal, 'z-score' as transform, stddev_samp(event_id) > 0 as applies from events_null
    union all select 'event_id', 0, 'log transform', count(event_id) = count(*) and min(event_id) > 0 from events_null
    union all select 'value', 2, 'z-score', stddev_samp(value) > 0 from events_null
    union all select 'value', 2, 'log transform', count(value) = count(*) and min(value) > 0 from events_null
    union all select 'event_type', 3, 'frequency encoding', true"""


@register("feat_plan", _PLAN + "".join(
    f" union all select 'ts', 1, '{p}', true" for p in ("year", "month", "weekday", "quarter")))
def feat_plan(t):
    return fea.feature_plan(t.events_null)
