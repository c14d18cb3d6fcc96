"""Report tables and nested context records, composed from the other operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabulyze.functions.columns import literal, numeric_columns, pick, rounded, side_by_side, string_columns
from tabulyze.operators import correlation, descriptive, rules, segments
from tabulyze.operators.facts import TableFacts
from tabulyze.operators.findings import first_filled, merged
from tabulyze.operators.kernel import null_counts, row_counts
from tabulyze.operators.profiling import missing_by_column
from tabulyze.operators.typing import target_by_variance


def _fact(section: str, column, metric: str, measure: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), (F.lit(None) if column is None else column).cast("string").alias("column"),
                    F.lit(metric).alias("metric"), measure.cast("double").alias("value"))


def dataset_summary(df: DataFrame, quality_score: float | None = None) -> DataFrame:
    """(section, column, metric, value): shape, duplicates, classes, missing profile, descriptives."""
    numeric = numeric_columns(df)
    shape = row_counts(df).select(F.inline(F.array(
        _fact("shape", None, "rows", F.col("n_rows")), _fact("shape", None, "columns", F.lit(len(df.columns))),
        _fact("shape", None, "numeric_columns", F.lit(len(numeric))),
        _fact("shape", None, "categorical_columns", F.lit(len(df.columns) - len(numeric))),
        _fact("shape", None, "duplicate_rows", F.col("n_rows") - F.col("distinct_rows")),
        _fact("shape", None, "quality_score", F.lit(quality_score).cast("double")))))
    missing = missing_by_column(df, only_missing=True).select(F.inline(F.array(
        _fact("missing", F.col("column"), "count", F.col("missing_count")),
        _fact("missing", F.col("column"), "pct", F.col("missing_pct")))))
    out = shape.unionByName(missing)
    if numeric:
        out = out.unionByName(descriptive.report_descriptives(df).select(F.inline(F.array(*[
            _fact("descriptive", F.col("column"), m, F.col(m)) for m in ("mean", "std", "min", "max", "median")]))))
    return out


def report_tables(df: DataFrame, risks: DataFrame) -> DataFrame:
    """(section, position, name, detail, value): each finding table in printing order, whole."""
    def cut(frame, section, order, name, detail, value):
        listed = frame.agg(F.collect_list(F.struct(
            *[o.alias(f"o{i}") for i, o in enumerate(order)], name.alias("name"),
            detail.cast("string").alias("detail"), value.cast("double").alias("value"))).alias("rows"))
        keyed = listed.select(F.posexplode(F.array_sort("rows")).alias("position", "r"))
        return keyed.select(F.lit(section).alias("section"), (F.col("position") + 1).alias("position"),
                            F.col("r.name").alias("name"), F.col("r.detail").alias("detail"),
                            F.col("r.value").alias("value"))
    col = F.col
    frames = [
        cut(missing_by_column(df, only_missing=True), "missing", [col("ordinal")], col("column"),
            col("missing_count"), col("missing_pct")),
        cut(descriptive.report_descriptives(df), "descriptive", [col("ordinal")], col("column"),
            F.lit("mean"), col("mean"))]
    if len(numeric_columns(df)) >= 2:
        pairs = correlation.corr_labelled(df).withColumn("size", -F.abs("correlation"))
        frames.append(cut(pairs, "correlation", [col("size"), col("feature_a"), col("feature_b")],
                          F.concat_ws(" / ", "feature_a", "feature_b"), col("strength"), col("correlation")))
    ranked = risks.withColumn("sev", rules.ranked("severity", ["High", "Medium", "Low"]))
    frames.append(cut(ranked, "risk", [col("sev"), col("category"), col("description")], col("description"),
                      col("severity"), F.lit(None)))
    numeric = numeric_columns(df)
    place = [numeric.index(c) if c in numeric else len(df.columns) + i for i, c in enumerate(df.columns)]
    inventory = null_counts(df).select("column", pick(place).alias("place"), "n").withColumn(
        "kind", F.when(col("place") < len(df.columns), "Numeric").otherwise("Categorical"))
    frames.append(cut(inventory, "inventory", [col("place")], col("column"), col("kind"), col("n")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def trend_bars(df: DataFrame, order: list[str], first: int | None = None, fallback: int | None = None) -> DataFrame:
    """Last-step % change of the KPIs; column means when no column has one."""
    kpis = descriptive.kpi_by_column(df, order)
    with_change = F.max(F.col("pct_change_last").isNotNull()).over(_all_columns())
    rows = kpis.withColumn("has_change", with_change)
    value = F.when(F.col("has_change"), F.col("pct_change_last")).otherwise(F.col("mean"))
    every = len(numeric_columns(df))
    limit = F.when(F.col("has_change"), every if first is None else first).otherwise(every if fallback is None else fallback)
    return (rows.filter(F.col("ordinal") < limit).select("column", value.alias("value"))
            .filter(F.col("value").isNotNull()).withColumn("is_positive", F.col("value") >= 0))


def _all_columns():
    return Window.partitionBy(F.lit(0))   # one row per column


def _listed(frame: DataFrame, name: str, order: list[str], *fields: str) -> DataFrame:
    """A bounded frame as one row holding a sorted array of structs."""
    return frame.agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))


def report_payload(df: DataFrame, order: list[str], quality_score: float | None = None,
                   forecast: DataFrame | None = None, prior: DataFrame | dict[str, DataFrame] | None = None) -> DataFrame:
    """One nested row with the report sections; every array is bounded by the column count or by what was handed in.

    ``prior`` holds findings of earlier stages by section. ``kpis`` (by column) win over the report's
    own, field by field; ``correlations`` replace them where there are any; ``risks`` (also given
    alone) are added; ``segments`` and ``drivers`` become sections of their own.
    """
    prior = {} if prior is None else prior if isinstance(prior, dict) else {"risks": prior}
    kpis = descriptive.kpi_by_column(df, order)
    if "kpis" in prior:
        kpis = merged({"earlier": prior["kpis"], "report": kpis}, ["column"])
    else:
        kpis = kpis.withColumn("source", F.lit("report"))
    pairs = first_filled(prior.get("correlations"), correlation.corr_labelled(df))
    frames = [
        _listed(dataset_summary(df, quality_score), "dataset_summary", ["section", "column", "metric"], "value"),
        _listed(kpis, "kpis", ["ordinal", "column"], "mean", "median", "std", "min", "max", "pct_change_last", "source"),
        _listed(pairs.withColumn("size", -F.abs("correlation")), "correlations",
                ["size", "feature_a", "feature_b"], "correlation", "strength"),
        _listed(rules.risk_signals(df, quality_score, prior.get("risks")).withColumn(
            "rank", rules.ranked("severity", ["High", "Medium", "Low"])), "risk_factors",
                ["rank", "category", "description"], "severity", "source")]
    for name in ("segments", "drivers"):
        if name in prior:
            frames.append(_listed(prior[name], name, prior[name].columns))
    if forecast is not None:
        frames.append(_listed(forecast, "forecast_summary", ["series"], "available", "trend_direction", "model_used",
                              "horizon", "confidence_level", "target_column"))
    return side_by_side(*frames)


def to_record(payload: DataFrame) -> DataFrame:
    """The nested row as one JSON text."""
    return payload.select(F.to_json(F.struct(*payload.columns)).alias("record"))


def _known(facts: TableFacts, name: str, rows: list[tuple], fields: str) -> DataFrame:
    """Rows the driver holds, at most one per column, as one row holding an array of structs."""
    frame = facts.df.sparkSession.createDataFrame(rows, fields)
    return _listed(frame, name, frame.columns)


def dashboard_context(df: DataFrame, facts: TableFacts | None = None) -> DataFrame:
    """One nested row: shape, KPIs, quality, strongest pairs, skews, missing columns, segment ends, trend, alerts.

    Everything is read from the shared ``facts``, so the table is scanned as often as they need.
    """
    facts = TableFacts(df) if facts is None else facts
    found, numeric, columns = facts.found, facts.numeric, facts.columns
    measures = rules.dashboard_facts(facts)
    gap = lambda r: r["n_rows"] - r["filled"]
    missing = [(i, c, r["missing_pct"]) for i, (c, r) in enumerate(columns.items()) if gap(r) > 0]
    frames = [measures.select("row_count", "col_count", "missing_pct", "duplicate_pct", "outlier_pct",
                              F.col("high_pairs").alias("high_corr_count"), F.col("direction").alias("trend_direction"),
                              F.col("pct_change").alias("trend_pct_change")), rules.kpis_from(measures),
              _listed(rules.alerts_from(measures).withColumn(
                  "rank", rules.ranked("severity", ["critical", "warning", "info"])), "alerts",
                      ["rank", "rule_no"], "severity", "category", "metric", "message"),
              _known(facts, "top_missing", missing, "ordinal int, column string, missing_pct double")]
    if len(numeric) >= 2:
        pairs = correlation.strongest(facts.correlations(), 5).select("a", "b", rounded("r", 4).alias("r"))
        frames.append(_listed(pairs.withColumn("size", -F.abs("r")), "strongest_pairs", ["size", "a", "b"], "r"))
    if numeric:
        # rounded as the database rounds, so that equal sizes are ties
        skews = facts.df.sparkSession.createDataFrame(
            [(i, c, columns[c]["skewness"]) for i, c in enumerate(numeric) if columns[c]["n"] > 3], "ordinal int, column string, s double")
        skews = skews.select("column", "ordinal", rounded("s", 4).alias("skew")).orderBy(F.abs("skew").desc(), "ordinal").limit(5)
        frames.append(_listed(skews.withColumn("size", -F.abs("skew")), "top_skewed", ["size", "column"], "skew"))
        over = [(i, c, facts.beyond[c]["over"]) for i, c in enumerate(numeric) if c in facts.beyond and facts.beyond[c]["over"] > 0]
        frames.append(_known(facts, "anomaly_columns", over, "ordinal int, column string, count long"))
    for name, end in zip(("top_segment", "bottom_segment"), facts.ends):
        if end is not None:
            frames.append(facts.row(**{name: literal(str(end["segment"])), f"{name}_value": literal(end["value"])}).withColumn(
                f"{name}_value", rounded(f"{name}_value", 4)))
    return side_by_side(*frames).select(
        "*", F.lit(len(numeric)).alias("numeric"), F.lit(len(found.of("categorical"))).alias("categorical"),
        F.lit(found.metric).alias("primary_metric"), F.lit(found.segment).alias("segment_col"))


def opportunity_context(df: DataFrame, segment: str | None = None, facts: TableFacts | None = None,
                        risks: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """One nested row: top drivers of the highest-variance column, gap between segments, gravest risks.

    Earlier results are taken over: ``facts`` of the table, a ``risk_watchlist``, the target column.
    """
    if target is None and facts is not None:
        every = [c for c in numeric_columns(facts.df)]
        target = max(every, key=lambda c: (facts.columns[c]["variance"] or 0.0, -every.index(c)))
    target = target or target_by_variance(df).first()["column"]
    strings = string_columns(df)
    segment = segment or (strings[0] if strings else None)
    drivers = correlation.key_drivers(df, target) if facts is None else correlation.drivers_of(facts.pairs_of(target))
    drivers = drivers.orderBy(F.col("abs_correlation").desc_nulls_last(), "column").limit(5).withColumn("size", -F.col("abs_correlation"))
    risks = rules.risk_watchlist(df) if risks is None else risks
    risks = (risks.withColumn("rank", rules.ranked("severity", ["critical", "high"]))
             .filter(F.col("severity").isin("critical", "high")).orderBy("rank", "risk", "column").limit(4))
    frames = [df.agg(F.count(F.lit(1)).alias("rows")) if facts is None else facts.row(rows=f"{facts.n_rows}L"),
              _listed(drivers, "top_drivers", ["size", "column"], "correlation", "direction"),
              _listed(risks, "key_risks", ["rank", "risk", "column"], "severity")]
    if segment:
        stats = segments.segment_stats(df, segment, target)
        frames.append(stats.agg(
            rounded(F.max("avg") - F.min("avg"), 4).alias("segment_gap"),
            F.max_by(F.col("segment").cast("string"), F.when(F.col("side") == "top", F.col("avg"))).alias("top_segment")))
    return side_by_side(*frames).select("*", F.lit(len(df.columns)).alias("columns"), F.lit(target).alias("primary_metric"),
                                        F.lit(segment).alias("segment_col"))


# What a context record is cut to. Paths are names joined by dots, ``*`` is any one
# name and ``**`` any number of them; arrays and maps do not count as a level, the keys of a map do.
DROPPED = (
    "**.forecast_values", "**.fitted_values", "**.forecast", "**.fitted", "**.lower", "**.upper", "**.lower_bound", "**.upper_bound",
    "**.downside", "**.upside", "**.risk_adjusted", "**.adjusted_forecast", "**.explanation")
FIRST = {"correlations": 10, "kpis": 10, "segment_performance": 5, "segment_performance.*": 5, "anomaly_details": 5,
         "anomaly_analysis.details": 5}
LAST = {"recent_periods": 6, "trend_analysis.recent_periods": 6, "trend_analysis.recent_12_periods": 6}
ONLY = {"dataset_summary.descriptive_stats.*": ("mean", "std", "min", "max")}
RENAMED = {"trend_analysis.recent_12_periods": "recent_6_periods"}


@dataclass(frozen=True)
class Trimming:
    """Rules by path: fields to drop, how many first or last entries of a list or map stay, the only
    fields that stay, and new names."""

    dropped: tuple[str, ...] = DROPPED
    first: dict[str, int] = field(default_factory=lambda: dict(FIRST))
    last: dict[str, int] = field(default_factory=lambda: dict(LAST))
    only: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(ONLY))
    renamed: dict[str, str] = field(default_factory=lambda: dict(RENAMED))

    def of(self, rules: dict, path: tuple[str, ...]):
        return next((v for p, v in rules.items() if _fits(tuple(p.split(".")), path)), None)

    def drops(self, path: tuple[str, ...]) -> bool:
        return any(_fits(tuple(p.split(".")), path) for p in self.dropped)


def _fits(pattern: tuple[str, ...], path: tuple[str, ...]) -> bool:
    if not pattern or not path:
        return not path and all(p == "**" for p in pattern)
    if pattern[0] == "**":
        return _fits(pattern[1:], path) or _fits(pattern, path[1:])
    return pattern[0] in ("*", path[0]) and _fits(pattern[1:], path[1:])


def _inside(cell: Column, kind: T.DataType, path: tuple[str, ...], rules: Trimming) -> Column:
    """A value without what the rules drop below it, at any depth; unchanged parts stay as they are."""
    if isinstance(kind, T.StructType):
        parts = [(f, (*path, f.name)) for f in kind.fields]
        only = rules.of(rules.only, path)
        kept = [_inside(cell.getField(f.name), f.dataType, p, rules).alias(rules.of(rules.renamed, p) or f.name)
                for f, p in parts if not rules.drops(p) and (only is None or f.name in only)]
        return F.when(cell.isNotNull(), F.struct(*kept)) if kept else F.lit(None).cast("string")
    first, last = rules.of(rules.first, path), rules.of(rules.last, path)
    if isinstance(kind, T.ArrayType):
        return _cut(F.transform(cell, lambda x: _inside(x, kind.elementType, path, rules)) if _nested(kind.elementType) else cell, first, last)
    if isinstance(kind, T.MapType):
        only, below = rules.of(rules.only, path), (*path, "*")
        dropped = [p.rsplit(".", 1)[-1] for p in rules.dropped]
        dropped = [name for name in dropped if rules.drops((*path, name))]
        entries = F.filter(F.map_entries(cell), lambda e: ~e["key"].cast("string").isin(dropped)) if dropped else F.map_entries(cell)
        if only is not None:
            entries = F.filter(entries, lambda e: e["key"].isin(list(only)))
        entries = _cut(entries, first, last)
        if _nested(kind.valueType):
            entries = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _inside(e["value"], kind.valueType, below, rules).alias("value")))
        return F.map_from_entries(entries)
    return cell


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def _cut(listed: Column, first: int | None, last: int | None) -> Column:
    if first is not None:
        return F.slice(listed, 1, first)
    if last is not None:
        return F.slice(listed, F.greatest(F.size(listed) - last + 1, F.lit(1)), F.lit(last))
    return listed


def trim_context(context: DataFrame, rules: Trimming | None = None) -> DataFrame:
    """The context cut to its rules at any depth: structs, lists of structs, maps, and what they hold.

    A null stays null, a list shorter than its limit stays whole, and a struct of which nothing
    is left becomes a null.
    """
    rules = Trimming() if rules is None else rules
    kept = [f for f in context.schema.fields if not rules.drops((f.name,))]
    return context.select(*[_inside(F.col(f"`{f.name}`"), f.dataType, (f.name,), rules).alias(rules.of(rules.renamed, (f.name,)) or f.name)
                            for f in kept])


# The parts of a context record, the name each has in it, and whether a part may
# carry its content in a field ``structured``, whose explanation is left out.
CONTEXT_PARTS = {
    "dataset_summary": ("dataset_summary", False), "kpis": ("kpis", False), "correlations": ("correlations", False),
    "risk_factors": ("risk_factors", False), "forecast_summary": ("forecast_summary", False),
    "segment_insights": ("segment_insights_raw", False), "copilot_insights": ("copilot_insights", False),
    "decision_summary": ("decision_summary", True), "forecast_intelligence": ("forecast_intelligence", True),
    "risk_intelligence": ("risk_intelligence", True), "scenario_insight": ("scenario_insight", True),
    "sensitivity_intelligence": ("sensitivity_intelligence", True), "strategic_recommendation": ("strategic_recommendation", True),
    "insight_drivers": ("key_driver_analysis", True), "segment_intelligence": ("segment_performance", True),
    "insight_anomalies": ("anomaly_analysis", True), "trend_intelligence": ("trend_analysis", True),
    "ai_opportunities": ("opportunity_analysis", True), "ai_risk_intelligence": ("risk_profile", True)}
LISTED_PARTS = ("correlations",)


def assemble_context(**parts: DataFrame | None) -> DataFrame:
    """One row with the given parts of ``CONTEXT_PARTS`` under the names they have in a record.

    A part is a one-row frame; ``correlations`` is a frame of findings and becomes a list in its
    order of size. Absent parts, and parts without a row, are left out.
    """
    unknown = sorted(set(parts) - set(CONTEXT_PARTS))
    if unknown:
        raise ValueError(f"no part of a context: {', '.join(unknown)}")
    named = {}
    for part, (name, structured) in CONTEXT_PARTS.items():
        frame = parts.get(part)
        if frame is None or frame.isEmpty():
            continue
        if part in LISTED_PARTS:
            listed = frame.agg(F.sort_array(F.collect_list(F.struct(*frame.columns))).alias(name))
            named[name] = listed.select(name)
            continue
        if structured and "structured" in frame.columns:
            frame = frame.select("structured.*")
        kept = [c for c in frame.columns if not (structured and c == "explanation")]
        named[name] = frame.select(F.struct(*kept).alias(name))
    return _one_row(list(named.values()))


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """One-row frames of one column next to each other, whatever their types."""
    if not frames:
        raise ValueError("the context has no part")
    types = {f.columns[0]: f.schema.fields[0].dataType for f in frames}
    rows = None
    for frame in frames:
        aligned = frame.select(*[F.col(c) if c == frame.columns[0] else F.lit(None).cast(t).alias(c) for c, t in types.items()])
        rows = aligned if rows is None else rows.unionAll(aligned)
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in types])   # one row per part


def merge_context(**parts: DataFrame | None) -> DataFrame:
    """One row whose columns are the given one-row parts as structs; absent parts are left out."""
    return _one_row([p.select(F.struct(*p.columns).alias(name)) for name, p in parts.items() if p is not None])
