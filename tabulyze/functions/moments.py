"""Bias-corrected shape statistics from Spark's population forms, as SQL text."""

from __future__ import annotations


def adjusted_skewness_sql(n: str, g1: str, low: str, high: str) -> str:
    """Sample skewness G1; NULL below 3 values, 0 for a constant column."""
    return (f"case when {n} < 3 then null when {low} = {high} then 0.0D "
            f"else {g1} * sqrt(cast({n} as double) * ({n} - 1)) / ({n} - 2) end")


def adjusted_kurtosis_sql(n: str, g2: str, low: str, high: str) -> str:
    """Sample excess kurtosis G2; NULL below 4 values, 0 for a constant column."""
    return (f"case when {n} < 4 then null when {low} = {high} then 0.0D "
            f"else ({n} - 1) / (cast({n} - 2 as double) * ({n} - 3)) * (({n} + 1) * {g2} + 6) end")
