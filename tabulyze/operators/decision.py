"""Risk bands, scenarios, sensitivities, signals and scorecards per forecast series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import numeric_columns, rounded
from tabulyze.functions.lookup import attach
from tabulyze.functions.storage import discard, written
from tabulyze.operators.forecast import best, models, volatility
from tabulyze.operators.kernel import numeric_profile
from tabulyze.operators.rules import fired, measured


def variance_concentration(df: DataFrame) -> DataFrame:
    """One row: sum of squared variance shares of the numeric columns, 1 for a single column."""
    columns = numeric_columns(df)
    if len(columns) < 2:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(1.0).alias("concentration_risk"))
    v = F.coalesce("variance", F.lit(0.0))
    # sum(v^2) / (sum(v) + e)^2, scaled by the largest share's own total so it cannot overflow
    return numeric_profile(df, columns, shape=False).agg(
        F.sum(v).alias("total"), F.collect_list(v).alias("vs")).select(   # one value per column
        F.aggregate("vs", F.lit(0.0), lambda s, x: s + F.pow(x / (F.col("total") + 1e-9), 2)).alias("concentration_risk"))


def two_sigma_shares(frame: DataFrame, fits: DataFrame) -> DataFrame:
    """(series, pressure): share of values beyond two population deviations of their series."""
    size = fits.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    lookup = fits.select("series", "n", "mean", "std_pop")
    rows = frame.filter(~F.col("is_halo")).select("series", "value")
    far = F.abs(F.col("value") - F.col("mean")) > 2 * (F.col("std_pop") + 1e-9)
    return (attach(rows, lookup, "series", size["k"], size["n"] or 0).filter(F.col("n").isNotNull())
            .groupBy("series").agg(F.avg(far.cast("double")).alias("anomaly_pressure")))


def risk_projection(forecasts: DataFrame, pressure: DataFrame, concentration: float) -> DataFrame:
    """Add volatility, concentration, pressure, stability and the three risk paths per series."""
    out = (forecasts.join(pressure, "series")   # both one row per series
           .withColumn("volatility", volatility()).withColumn("concentration_risk", F.lit(float(concentration))))
    shock = F.when(F.col("forecast_std") > 0, F.col("volatility") * F.col("forecast_std")).otherwise(F.col("std_pop"))
    out = out.withColumn("shock", shock)
    instability = F.col("volatility") + F.col("concentration_risk") + F.col("anomaly_pressure")
    drag = F.col("concentration_risk") * F.col("shock") * 0.5 + F.col("anomaly_pressure") * F.col("shock") * 0.3
    return (out.withColumn("downside", F.transform("forecast", lambda v: v - F.col("shock") * 1.5))
            .withColumn("upside", F.transform("forecast", lambda v: v + F.col("shock")))
            .withColumn("risk_adjusted", F.transform("forecast", lambda v: v - drag))
            .withColumn("stability_score", _within((1 - instability / 3) * 10, 0, 10)))


def staged_risk(frame: DataFrame, df: DataFrame, horizon: int = 6) -> DataFrame:
    """The ``risk_projection`` of every series of ``frame``, written once: one row per series that
    scenarios, signals, scorecards and records read without fitting anything again.

    The series are fitted once, too: the fits are written, and gone when the risks are.
    ``df`` is the table whose numeric columns tell the concentration of the variance.
    """
    fits = written(models(frame), "fits")
    concentration = variance_concentration(df).first()["concentration_risk"]
    risk = written(risk_projection(best(fits, horizon), two_sigma_shares(frame, fits), concentration), "risk")
    discard(fits)
    return risk


def _within(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def levers(marketing: float = 0.0, price: float = 0.0, demand: float = 0.0, season: float = 0.0) -> dict[str, float]:
    """Scenario parameters of the four business levers, all in percent."""
    return {"growth": marketing * 0.6 + price * 0.4, "volatility": season,
            "concentration": max(0.0, -demand), "demand": demand}


def scenario_grid(risk: DataFrame, scenarios: dict[str, dict[str, float]]) -> DataFrame:
    """Every series under every named scenario: change of the forecast and risk impact.

    The scenarios are literals that each row unfolds in place, so no join is needed.
    """
    names = ("growth", "volatility", "concentration", "demand")
    grid = F.array(*[F.struct(F.lit(n).alias("scenario"), *[F.lit(float(p.get(k, 0.0))).alias(k) for k in names])
                     for n, p in scenarios.items()])
    rows = risk.select("series", "forecast", "forecast_std", "horizon", F.col("volatility").alias("base_volatility"),
                       F.col("concentration_risk").alias("base_concentration"), "anomaly_pressure", F.inline(grid))
    factor = (1 + F.col("growth") / 100) * (1 + F.col("demand") / 100)
    base = F.aggregate("forecast", F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("factor", factor).withColumn("base_sum", base)
    spread = F.col("forecast_std") * F.abs("factor")
    vol = F.col("base_volatility") * (1 + F.col("volatility") / 100)
    conc = F.col("base_concentration") * F.greatest(F.lit(0.0), 1 - F.col("concentration") / 100)
    shock = F.when(spread > 0, vol * spread).otherwise(1.0)
    return rows.select(
        "series", "scenario", *names, "base_sum", (F.col("base_sum") * F.col("factor")).alias("adjusted_sum"),
        (F.col("base_sum") * (F.col("factor") - 1)).alias("revenue_delta"),
        (conc * shock + F.col("anomaly_pressure") * shock * 0.3).alias("risk_impact"),
        (F.col("base_sum") * (F.col("factor") - 1) / F.col("horizon")).alias("mean_change"),
        F.transform("forecast", lambda v: v * F.col("factor")).alias("adjusted_forecast"))


SENSITIVITY = {"Growth": "growth", "Volatility": "volatility", "Concentration": "concentration", "Demand Shock": "demand"}


def sensitivity(risk: DataFrame, delta: float = 10.0) -> DataFrame:
    """Elasticity of the forecast sum to each lever, ranked by size within the series.

    Only growth and demand move the adjusted forecast; the other two stay at 0.
    """
    grid = scenario_grid(risk, {name: {key: delta} for name, key in SENSITIVITY.items()})
    e = F.coalesce(F.try_divide(F.try_divide(F.col("adjusted_sum") - F.col("base_sum"), "base_sum"),
                                F.lit(delta / 100)), F.lit(0.0))
    order = F.lit(0)
    for i, name in enumerate(SENSITIVITY):
        order = F.when(F.col("scenario") == name, i).otherwise(order)
    # the four levers tie in pairs: rank by rounded size, then lever order
    listed = grid.select("series", F.struct((-rounded(F.abs(e), 9)).alias("size"), order.alias("o"),
                                            F.col("scenario").alias("lever"), e.alias("elasticity")).alias("s"))
    return (listed.groupBy("series").agg(F.sort_array(F.collect_list("s")).alias("levers"))   # four per series
            .select("series", F.posexplode("levers").alias("place", "s"))
            .select("series", F.col("s.lever").alias("lever"), F.col("s.elasticity").alias("elasticity"),
                    (F.col("place") + 1).alias("rank")))


def growth_rate() -> Column:
    first, last = F.element_at("forecast", 1), F.element_at("forecast", -1)
    return F.when(F.size("forecast") >= 2, (last - first) / (F.abs(first) + 1e-9)).otherwise(0.0)


# Our own words for each signal: why it fired, with the measures they quote.
SIGNAL_WORDS = {
    "Expansion Opportunity": ("%s: the forecast grows by %.1f%% at volatility %.2f and concentration %.2f", "growth_pct", "volatility", "concentration_risk"),
    "Diversification Required": ("%s: growth of %.1f%% rests on a concentration of %.2f", "growth_pct", "concentration_risk"),
    "Cautious Optimism": ("%s: growth of %.1f%% against volatility %.2f and concentration %.2f", "growth_pct", "volatility", "concentration_risk"),
    "Contraction Alert": ("%s: the forecast changes by %.1f%%", "growth_pct"),
    "Hedge Exposure": ("%s: volatility of %.2f is above 0.2", "volatility"),
    "Operational Risk Flag": ("%s: %.1f%% of the values lie beyond two deviations", "pressure_pct"),
    "Stable State": ("%s: no limit is passed, growth %.1f%%", "growth_pct")}


def decision_signals(risk: DataFrame) -> DataFrame:
    """Signals per series from growth, volatility, concentration and anomaly pressure.

    ``evidence`` maps all four measures to their values, and ``rationale`` says from them why a
    signal fired.
    """
    g, v, c, p = F.col("growth"), F.col("volatility"), F.col("concentration_risk"), F.col("anomaly_pressure")
    strong, moderate, declining = g > 0.05, (g > 0) & (g <= 0.05), g < 0
    calm = (v < 0.15) & (c < 0.4)
    # fixed values: signal names and severities
    none = ~(strong & calm) & ~(strong & (c > 0.5)) & ~(moderate & ~calm) & ~declining & ~(v > 0.2) & ~(p > 0.1)
    def signal(test, name, strategy, severity, measure, value):
        return test, {"signal": F.lit(name), "severity": F.lit(severity), "strategy": F.lit(strategy),
                      "measure": F.lit(measure), "value": value}
    facts = risk.withColumn("growth", growth_rate()).withColumn("evidence", measured(
        growth_pct=g * 100, volatility=v, concentration_risk=c, pressure_pct=p * 100))
    out = fired(facts, [
        signal(strong & calm, "Expansion Opportunity", "Add capacity while risk is low", "positive", "growth", g),
        signal(strong & (c > 0.5), "Diversification Required", "Spread the base before growing further", "warning",
               "concentration_risk", c),
        signal(moderate & ~calm, "Cautious Optimism", "Grow in steps under risk controls", "warning", "growth", g),
        signal(declining, "Contraction Alert", "Protect margins and defer optional spending", "critical", "growth", g),
        signal(v > 0.2, "Hedge Exposure", "Add buffers against swings", "warning", "volatility", v),
        signal(p > 0.1, "Operational Risk Flag", "Find the cause of the anomalies", "critical", "anomaly_pressure", p),
        signal(none, "Stable State", "Keep course and monitor", "positive", "growth", g)], keep=["series", "evidence"])
    text = F.lit(None).cast("string")
    for name, (template, *measures) in SIGNAL_WORDS.items():
        text = F.when(F.col("signal") == name, F.format_string(template, "series", *[F.col("evidence")[m] for m in measures])).otherwise(text)
    return out.withColumn("rationale", text)


def scorecard(risk: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per series: growth, risk, stability, confidence, readiness and a summary class."""
    counts = signals.groupBy("series").agg(
        F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"),
        F.count(F.when(F.col("severity") == "warning", 1)).alias("warning"))
    growth = _within((growth_rate() + 0.3) / 0.6 * 10, 0, 10)
    exposure = _within((F.col("volatility") * 4 + F.col("concentration_risk") * 4
                        + F.col("anomaly_pressure") * 2) * 10, 0, 10)
    raw = (F.col("g") * 0.35 + (10 - F.col("r")) * 0.25 + F.col("stability_score") * 0.20
           + F.col("confidence") / 10 * 0.20 - (F.col("critical") * 1.5 + F.col("warning") * 0.5))
    scored = (risk.join(counts, "series").withColumn("g", growth).withColumn("r", exposure)
              .withColumn("ready", _within(raw, 0, 10)))
    return scored.select(
        "series", rounded("g", 2).alias("growth_strength"), rounded("r", 2).alias("risk_exposure"),
        rounded("stability_score", 2).alias("stability_score"), rounded("confidence", 1).alias("forecast_confidence"),
        rounded("ready", 2).alias("strategic_readiness"),
        F.when(F.col("ready") >= 7, "strong").when(F.col("ready") >= 4, "moderate").otherwise("elevated risk")
        .alias("summary"))


def decision_context(risk: DataFrame, scenario: DataFrame, levers_ranked: DataFrame) -> DataFrame:
    """One rounded record per series; ``scenario`` is one row per series of a ``scenario_grid``."""
    top = levers_ranked.groupBy("series").agg(
        F.sort_array(F.collect_list(F.struct("rank", "lever", rounded("elasticity", 4).alias("elasticity"))))
        .alias("sensitivity_ranking"))   # four per series
    picked = scenario.select("series", "revenue_delta", "risk_impact")
    return (risk.join(picked, "series").join(top, "series").select(
        "series", rounded(growth_rate() * 100, 2).alias("forecast_growth_pct"),
        rounded("confidence", 1).alias("forecast_confidence_pct"), F.col("model").alias("best_model"),
        rounded("rmse", 4).alias("model_rmse"), rounded(F.col("volatility") * 10, 2).alias("risk_score"),
        rounded("concentration_risk", 3).alias("concentration_risk"),
        rounded(F.col("anomaly_pressure") * 100, 2).alias("anomaly_pressure_pct"),
        rounded("stability_score", 2).alias("stability_score"),
        rounded("revenue_delta", 2).alias("scenario_revenue_delta"),
        rounded("risk_impact", 4).alias("scenario_risk_impact"),
        F.element_at("sensitivity_ranking", 1)["lever"].alias("top_sensitivity_driver"),
        F.transform("sensitivity_ranking", lambda s: F.struct(s["lever"].alias("variable"), s["elasticity"]))
        .alias("sensitivity_ranking")))
