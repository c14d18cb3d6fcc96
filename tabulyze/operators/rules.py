"""KPIs and rule findings.

A rule is a struct guarded by its condition. Rules over one fact row, or over one
row per column, are put in an array, the ones that do not hold are dropped, and the
rest become rows: one pass over a frame that is already tiny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import literal, numeric_columns, percent, rounded, string_columns
from tabulyze.operators import anomalies, correlation, segments
from tabulyze.operators.facts import TableFacts
from tabulyze.operators.kernel import null_counts, numeric_profile, with_quantiles
from tabulyze.operators.quantiles import exact_quantiles


def fired(facts: DataFrame, rules: list[tuple[Column, dict[str, Column]]], keep: list[str] | None = None) -> DataFrame:
    """Rows of the rules that hold, with ``rule_no`` for a stable order."""
    structs = [F.when(test, F.struct(F.lit(i).alias("rule_no"), *[c.alias(n) for n, c in fields.items()]))
               for i, (test, fields) in enumerate(rules)]
    return facts.select(*(keep or []), F.inline(F.filter(F.array(*structs), lambda s: s.isNotNull())))


def ranked(name: str, order: list[str]) -> Column:
    """Position of a label in ``order``, unknown labels last."""
    place = F.lit(len(order))
    for i, label in reversed(list(enumerate(order))):
        place = F.when(F.col(name) == label, i).otherwise(place)
    return place


# --- executive KPIs and alerts ------------------------------------------------------------

def dashboard_facts(facts: TableFacts) -> DataFrame:
    """One row with every measure the KPIs and alerts read."""
    columns, numeric = facts.columns, facts.numeric
    n_rows = facts.n_rows
    gaps = [(f["n_rows"] - f["filled"]) / f["n_rows"] for f in columns.values()]
    missing = round(sum(gaps) / len(gaps) * 100, 2)
    skewed = sum(1 for c in numeric if columns[c]["n"] > 3 and abs(round(columns[c]["skewness"], 4)) > 2)
    beyond = facts.beyond if numeric else {}
    cells = sum(columns[c]["n"] for c in numeric if columns[c]["n"] >= 4)
    m = columns[facts.found.metric] if facts.found.metric else None
    volatility = min(m["std"] / (abs(m["mean"]) + 1e-9), 1.0) if m and m["n"] > 1 else 0.0
    parts = {"concentration_risk": 0.0, "segment_dominance": 0.0, "pct_change": 0.0, "direction": None}
    if facts.concentration is not None:
        parts |= facts.concentration.asDict()
    if facts.change is not None:
        parts |= {"pct_change": facts.change["pct_change"] or 0.0, "direction": facts.change["direction"]}
    return facts.row(
        row_count=f"{n_rows}L", col_count=str(len(facts.df.columns)), missing_pct=literal(missing),
        duplicate_pct=f"round({n_rows - facts.distinct_rows} * 100.0D / {n_rows} * 100) / 100",
        completeness_score=f"round((100 - {literal(missing)}) * 100) / 100", severe_skews=f"{skewed}L",
        outlier_pct=f"round({sum(r['outside'] for r in beyond.values())} * 100.0D / {max(cells, 1)} * 100) / 100",
        pressure=f"least({sum(r['over'] for r in beyond.values())} / {float(n_rows)}D, 1.0D)", high_pairs=f"{facts.high_pairs}L",
        **{name: f"cast({literal(value)} as {'string' if name == 'direction' else 'double'})" for name, value in parts.items()},
        volatility=literal(round(volatility, 4)))


def executive_kpis(df: DataFrame, facts: TableFacts | None = None) -> DataFrame:
    """One row: health, concentration, volatility, growth, dominance, pressure, completeness."""
    return kpis_from(_measures(df, facts))


def _measures(df: DataFrame, facts: TableFacts | None) -> DataFrame:
    """The measures of given facts, or of the table's own, which nothing reads any more afterwards."""
    if facts is not None:
        return dashboard_facts(facts)
    own = TableFacts(df)
    measures = dashboard_facts(own)
    own.close()
    return measures


def kpis_from(facts: DataFrame) -> DataFrame:
    penalty = (F.col("missing_pct") * 0.40 + F.col("duplicate_pct") * 0.25 + F.col("outlier_pct") * 0.20
               + F.col("pressure") * 100 * 0.15)
    return facts.select(
        rounded(F.greatest(F.lit(0.0), 100 - penalty), 1).alias("health_score"),
        rounded("concentration_risk", 4).alias("concentration_risk"), F.col("volatility").alias("volatility_score"),
        rounded("pct_change", 2).alias("growth_signal"), "segment_dominance",
        rounded("pressure", 4).alias("anomaly_pressure"), F.col("completeness_score").alias("data_completeness"))


def health_class(score: Column) -> Column:
    return F.when(score >= 80, "HEALTHY").when(score >= 60, "MODERATE").otherwise("CRITICAL")


def volatility_by_column(df: DataFrame, top: int | None = 3) -> DataFrame:
    """|std / mean| per numeric column, 0 for a zero mean, largest first."""
    score = F.coalesce(F.abs(F.try_divide("std", "mean")), F.lit(0.0))
    out = (numeric_profile(df, shape=False).select("column", "ordinal", rounded(score, 4).alias("volatility"))
           .orderBy(F.col("volatility").desc(), "ordinal"))
    return (out.limit(top) if top else out).select("column", "volatility")


def alerts(df: DataFrame, facts: TableFacts | None = None) -> DataFrame:
    """Threshold alerts on the executive measures, critical first."""
    return alerts_from(_measures(df, facts))


def alerts_from(facts: DataFrame) -> DataFrame:
    facts = facts.withColumn("pressure", rounded("pressure", 4))
    c = F.col
    def alert(test, severity, category, metric, value, text):
        return test, {"severity": F.lit(severity), "category": F.lit(category), "metric": F.lit(metric),
                      "value": value.cast("double"), "message": F.format_string(text, value.cast("double"))}
    rules = [
        alert(c("missing_pct") >= 20, "critical", "quality", "missing_pct", c("missing_pct"),
              "%.1f%% of cells are missing, over the 20%% limit"),
        alert((c("missing_pct") >= 10) & (c("missing_pct") < 20), "warning", "quality", "missing_pct",
              c("missing_pct"), "%.1f%% of cells are missing; check the imputation"),
        alert(c("duplicate_pct") >= 5, "warning", "quality", "duplicate_pct", c("duplicate_pct"),
              "%.1f%% of rows are duplicates"),
        alert(c("outlier_pct") >= 15, "critical", "quality", "outlier_pct", c("outlier_pct"),
              "%.1f%% of numeric cells are outliers"),
        alert(c("concentration_risk") >= 0.6, "critical", "risk", "concentration_risk", c("concentration_risk"),
              "Concentration index %.2f: the top segment dominates"),
        alert((c("concentration_risk") >= 0.35) & (c("concentration_risk") < 0.6), "warning", "risk",
              "concentration_risk", c("concentration_risk"), "Concentration index %.2f is elevated"),
        alert(c("volatility") >= 0.6, "warning", "risk", "volatility_score", c("volatility"),
              "Main metric is volatile, CV %.2f"),
        alert(c("high_pairs") > 0, "info", "risk", "high_corr_pairs", c("high_pairs"),
              "%.0f pairs of columns correlate at 0.75 or more"),
        alert((c("direction") == "down") & (F.abs(c("pct_change")) >= 10), "critical", "trend", "growth_signal",
              c("pct_change"), "Main metric fell %.1f%% over the period"),
        alert(c("direction") == "up", "info", "trend", "growth_signal", c("pct_change"),
              "Main metric grew %.1f%% over the period"),
        alert(c("pressure") >= 0.05, "warning", "anomaly", "anomaly_pressure", c("pressure"),
              "Anomaly pressure %.3f"),
        alert(c("severe_skews") >= 3, "warning", "quality", "skewed_cols", c("severe_skews"),
              "%.0f columns have an absolute skew over 2"),
    ]
    return fired(facts, rules).orderBy(ranked("severity", ["critical", "warning", "info"]), "rule_no")


# --- report risks ---------------------------------------------------------------------------

def risk_signals(df: DataFrame, quality_score: float | None = None, prior: DataFrame | None = None) -> DataFrame:
    """Missing, low-quality and skew risks plus findings handed in, High first.

    ``prior`` has category, description, severity and source; missing ones get defaults.
    """
    missing = (null_counts(df)
               .select("column", "ordinal",
                       rounded(percent(F.col("n_rows") - F.col("n"), F.col("n_rows")), 2).alias("pct"))
               .filter(F.col("pct") >= 20)
               .select(F.lit(0).alias("part"), "ordinal", F.lit("Data Quality").alias("category"), "column",
                       F.col("pct").alias("value"),
                       F.format_string("%s: %.2f%% of values are missing", "column", "pct").alias("description"),
                       F.when(F.col("pct") >= 50, "High").otherwise("Medium").alias("severity"),
                       F.lit("Dataset").alias("source")))
    out = missing
    if numeric_columns(df):
        skews = numeric_profile(df).filter(F.abs("skewness") > 2).select(
            F.lit(2).alias("part"), "ordinal", F.lit("Statistical").alias("category"), "column",
            F.abs("skewness").alias("value"),
            F.format_string("%s: absolute skew %.2f", "column", F.abs("skewness")).alias("description"),
            F.lit("Low").alias("severity"), F.lit("EDA").alias("source"))
        out = out.unionByName(skews)
    if quality_score is not None and quality_score < 70:
        low = df.limit(1).select(
            F.lit(1).alias("part"), F.lit(0).alias("ordinal"), F.lit("Data Quality").alias("category"),
            F.lit(None).cast("string").alias("column"), F.lit(float(quality_score)).alias("value"),
            F.lit(f"Overall quality score is {quality_score:.1f}").alias("description"),
            F.lit("High").alias("severity"), F.lit("Tab 1").alias("source"))
        out = out.unionByName(low)
    if prior is not None:
        have = lambda n, default: (F.coalesce(F.col(n), F.lit(default)) if n in prior.columns else F.lit(default))
        out = out.unionByName(prior.select(
            F.lit(3).alias("part"), F.lit(0).alias("ordinal"), have("category", "General").alias("category"),
            F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("value"),
            F.col("description"), have("severity", "Low").alias("severity"), have("source", "Pipeline").alias("source")))
    return out.orderBy(ranked("severity", ["High", "Medium", "Low"]), "part", "ordinal", "description").drop("part", "ordinal")


# --- hidden patterns and watch list --------------------------------------------------------

def measured(**values: Column) -> Column:
    """The evidence of a finding: every measure it rests on, by name; absent ones are left out."""
    full = F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v.cast("double"))])
    return F.map_filter(full, lambda _, v: v.isNotNull())


def worded(text: str, *names: str) -> Column:
    """A message made from the column's name and measures of the ``evidence``."""
    return F.format_string(text, "column", *[F.col("evidence")[n] for n in names])


def evidence_rows(findings: DataFrame, *keys: str) -> DataFrame:
    """One row per finding and measure: the keys, ``measure`` and ``amount``."""
    return findings.select(*keys, F.explode("evidence").alias("measure", "amount"))


def hidden_patterns(df: DataFrame, top: int | None = None) -> DataFrame:
    """Heavy tails, skew, variability, compressed quartiles and near-copies, high severity first.

    ``evidence`` maps each measure of a finding to its value; the ``message`` is made from it.
    """
    columns = numeric_columns(df)
    qs = exact_quantiles(df, columns, [0.25, 0.75])
    facts = with_quantiles(numeric_profile(df, columns), qs, ["q1", "q3"]).filter(F.col("n") >= 4)
    c = F.col
    kurt, skew = F.abs("kurtosis"), F.abs("skewness")
    cv = F.coalesce(F.abs(F.try_divide("std", "mean")), F.lit(0.0))
    squeeze = F.try_divide(F.col("q3") - F.col("q1"), F.col("max") - F.col("min"))
    # fixed values: limits, types and severities
    def pattern(test, kind, metric, value, severe, message, **evidence):
        shown = measured(n=c("n"), **evidence)
        return test, {"type": kind if isinstance(kind, Column) else F.lit(kind), "metric": F.lit(metric),
                      "value": value, "severity": F.when(severe, "high").otherwise("medium"), "evidence": shown,
                      "wording": F.lit(message)}
    rules = [
        pattern(kurt > 5, "Structural", "kurtosis", c("kurtosis"), kurt > 10, "heavy_tails", kurtosis=c("kurtosis"), std=c("std")),
        pattern(skew > 2, F.when(skew > 4, "Structural").otherwise("Noise"), "skewness", c("skewness"), skew > 4, "skewed",
                skewness=c("skewness"), mean=c("mean")),
        pattern(cv > 1.5, "Noise", "cv", cv, cv > 3, "variable", cv=cv, mean=c("mean"), std=c("std")),
        pattern((squeeze < 0.10) & (c("n") > 20), "Cyclical", "iqr_range", squeeze, F.lit(False), "squeezed",
                iqr_range=squeeze, iqr=c("q3") - c("q1"), range=c("max") - c("min"))]
    out = fired(facts, rules, keep=["column", "ordinal"])
    if len(columns) >= 2:
        copies = correlation.correlation_pairs(df, columns).filter(F.abs("r") > 0.92).select(
            F.concat("a", F.lit(" × "), "b").alias("column"),
            (F.lit(len(columns)) * (F.col("a_ordinal") + 1) + F.col("b_ordinal")).alias("ordinal"),
            F.lit(len(rules)).alias("rule_no"), F.lit("Structural").alias("type"), F.lit("r").alias("metric"),
            F.abs("r").alias("value"), F.lit("high").alias("severity"), measured(n=c("n"), r=c("r")).alias("evidence"),
            F.lit("copies").alias("wording"))
        out = out.unionByName(copies)
    out = out.orderBy(ranked("severity", ["high", "medium", "low"]), "type", "ordinal", "rule_no")
    return ((out.limit(top) if top else out)
            .select("type", "column", "metric", rounded("value", 4).alias("value"), "severity", "evidence",
                    _message(PATTERN_WORDS).alias("message")))


# Our own words for each kind of finding, with the measures they quote.
PATTERN_WORDS = {
    "heavy_tails": ("%s: tails far heavier than normal, kurtosis %.2f", "kurtosis"),
    "skewed": ("%s: lopsided values, skewness %.2f about a mean of %.2f", "skewness", "mean"),
    "variable": ("%s: deviation is %.2f times the mean", "cv"),
    "squeezed": ("%s: half of the values lie within %.3f of the range", "iqr_range"),
    "copies": ("%s: nearly the same column twice, r %.4f over %.0f rows", "r", "n")}
RISK_WORDS = {
    "Concentration Risk": ("%s: one value fills %.2f of %.0f cells", "top_share", "filled"),
    "High Volatility": ("%s: deviation is %.2f times the mean", "cv"),
    "Anomaly Pressure": ("%s: %.0f values beyond three deviations (%.2f%%), the farthest at %.1f", "n_anomalies", "pct", "max_z"),
    "Skewed Distribution": ("%s: skewness %.2f pulls the mean away from the middle", "skewness"),
    "Missing Data": ("%s: %.0f cells missing (%.1f%%)", "missing", "missing_pct")}


def _message(words: dict[str, tuple[str, ...]], kind: str = "wording") -> Column:
    text = F.lit(None).cast("string")
    for name, (template, *measures) in words.items():
        text = F.when(F.col(kind) == name, worded(template, *measures)).otherwise(text)
    return text


def risk_watchlist(df: DataFrame, top: int | None = None, text_columns: int | None = None) -> DataFrame:
    """Concentration, volatility, anomaly, skew and missing-data risks, critical first.

    ``evidence`` maps each measure of a risk to its value; the ``message`` is made from it.
    """
    level = lambda v, *limits: F.when(v > limits[0], limits[1]).otherwise(
        F.when(v > limits[2], limits[3]).otherwise("medium") if len(limits) > 2 else F.lit("medium"))
    def risk(frame, part, name, value, severity, **evidence):
        return frame.select(F.lit(part).alias("part"), "ordinal", F.lit(name).alias("risk"), "column",
                            rounded(value, 4).alias("value"), severity.alias("severity"), measured(**evidence).alias("evidence"))
    c = F.col
    frames = []
    if string_columns(df):
        share = segments.top_value_share(df, text_columns).filter(F.col("top_share") > 0.5)
        frames.append(risk(share, 0, "Concentration Risk", c("top_share"), level(c("top_share"), 0.80, "critical", 0.65, "high"),
                           top_share=c("top_share"), top_n=c("top_n"), filled=F.round(c("top_n") / c("top_share"))))
    numeric = numeric_columns(df)
    if numeric:
        profile = numeric_profile(df, numeric)
        cv = F.abs(F.try_divide("std", "mean"))
        frames.append(risk(profile.filter((F.col("n") >= 4) & (cv > 1)), 1, "High Volatility", cv,
                           level(cv, 3, "critical", 2, "high"), cv=cv, mean=c("mean"), std=c("std")))
        watch = anomalies.anomaly_watch(df).withColumn("ordinal", ranked("column", numeric))
        frames.append(risk(watch, 2, "Anomaly Pressure", c("pct"), level(c("pct"), 5, "high"),
                           n_anomalies=c("n_anomalies"), pct=c("pct"), max_z=c("max_z")))
        skew = F.abs("skewness")
        frames.append(risk(profile.filter(skew > 3), 3, "Skewed Distribution", c("skewness"), level(skew, 6, "high"),
                           skewness=c("skewness"), mean=c("mean")))
    missing = F.col("n_rows") - F.col("n")
    gap = percent(missing, F.col("n_rows"))
    frames.append(risk(null_counts(df).filter(gap > 5), 4, "Missing Data", gap, level(gap, 30, "critical", 15, "high"),
                       missing=missing, missing_pct=gap))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    out = out.withColumn("message", _message(RISK_WORDS, "risk")).orderBy(
        ranked("severity", ["critical", "high", "medium", "low"]), "part", "ordinal")
    return ((out.limit(top) if top else out)
            .drop("part", "ordinal"))


def risk_profile(df: DataFrame, anomaly_columns: int | DataFrame = 0) -> DataFrame:
    """(indicator, column, value): skewed, most volatile and incomplete columns, and their total.

    ``anomaly_columns`` is the number of columns with anomalies, or an ``anomaly_totals`` frame.
    """
    profile = numeric_profile(df).select("column", "ordinal", rounded("skewness", 4).alias("skew"))
    skewed = profile.filter(F.abs("skew") > 2).select(
        F.lit("high_skew").alias("indicator"), "column", F.col("skew").alias("value"))
    volatile = volatility_by_column(df, 3).select(
        F.lit("high_volatility").alias("indicator"), "column", F.col("volatility").alias("value"))
    missing = null_counts(df).filter(F.col("n") < F.col("n_rows")).select(
        F.lit("missing").alias("indicator"), "column",
        rounded(percent(F.col("n_rows") - F.col("n"), F.col("n_rows")), 2).alias("value"))
    listed = skewed.unionByName(missing)
    extra = (F.lit(anomaly_columns) if isinstance(anomaly_columns, int)
             else anomaly_columns.select("columns_with_anomalies").scalar())
    total = listed.agg(F.count("*").alias("k")).select(
        F.lit("overall").alias("indicator"), F.lit(None).cast("string").alias("column"),
        (F.col("k") + extra).cast("double").alias("value"))
    return listed.unionByName(volatile).unionByName(total)


def finding_counts(findings: DataFrame, by: str) -> DataFrame:
    """Findings per severity, type or strength."""
    return findings.groupBy(F.col(by).alias("label")).agg(F.count("*").alias("count"))
