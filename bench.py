"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES an
optional comma-separated list of other registered queries. Operators are timed with their
whole results, without the rounding that the registry adds for comparing engines.
"""

from __future__ import annotations

import json
import os
import re
import time

from tabulyze.plans.catalog import OPERATORS
from tabulyze.session import local_session

HEADLINE = [
    "schema_profile", "missing_by_column", "cardinality_text", "column_roles", "quality_score_app", "numerical_summary",
    "categorical_summary", "distribution_summary", "histogram_fixed", "kde_curve", "corr_strongest", "key_drivers",
    "segment_ranking_top", "segment_custom", "performance_matrix", "time_trend_monthly", "event_counts_rolling",
    "anomaly_counts", "cap_outliers", "clean_strict", "feat_zscore", "feat_freq_enc", "executive_kpis", "alerts_orders",
    "risk_watchlist", "fc_best", "fc_best_rows", "scenario_grid", "decision_scorecard", "report_tables"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("tabulyze-bench", os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "12g"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    # start the executor threads, the code generator and the Python workers before the clock
    for name in ("segment_ranking_top", "corr_strongest"):
        OPERATORS[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        OPERATORS[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
